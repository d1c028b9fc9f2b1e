import importlib
import json
import sys
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from gazetta import cli
from gazetta.operators import index as X
from gazetta.operators import search as Q
from gazetta.options import Options
from gazetta.plans import queries as P
from gazetta.plans.ingest import index, ingest, reset
from gazetta.schemas import CHUNKS
from gazetta.sources import json_feed as J
from gazetta.store import Store
from gazetta.streaming.incremental import running_counts, start

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def now():
    return F.expr("TIMESTAMP '2026-04-14 12:00:00'")


def payload(*numbers):
    return json.dumps({"data": [{"fileExt": "pdf", "fileDept": "D", "circNumber": str(n), "cirDate": f"202604{n:02d}", "circDisplayNo": "", "sub": f"title {n}", "circFilelink": "u"} for n in numbers]})


def detected(spark, *numbers):
    return J.detected(spark.createDataFrame([("f", payload(*numbers))], "file string, payload string"), now()).withColumn("pos", F.lit(1))


def contents(spark, *rows):
    return spark.createDataFrame([("NSE", *r) for r in rows], "source string, circular_id string, content binary, error string")


def test_ingest_index_search(spark, tmp_path):
    store, options = Store(spark, str(tmp_path / "store")), Options(storage_path=str(tmp_path / "raw"), chunk_size=40, chunk_overlap=5)
    loaded = contents(spark, ("D1", b"%PDF margin framework update for the members", None), ("D2", b"%PDF " + b"other words " * 20, None), ("D3", None, "timed out"))
    first = ingest(store, detected(spark, 1, 2, 3), loaded, date(2026, 4, 14), now(), options, batch=0)
    assert first.version == 1 and first.rejected == 0
    assert [(r.source, r.detected, r.fetched, r.failed, r.skipped, r.first_failed) for r in first.counters] == [("NSE", 3, 2, 1, 0, date(2026, 4, 3))]
    assert {r.circular_id: r.status for r in store.table("circulars").collect()} == {"D1": "FETCHED", "D2": "FETCHED", "D3": "FAILED"}
    assert store.table("scraper_checkpoints").first().last_run_date == date(2026, 4, 10)
    assert ingest(store, detected(spark, 1), loaded, date(2026, 4, 14), now(), options, batch=0).version == 1
    again = ingest(store, detected(spark, 1, 2, 3), contents(spark, ("D3", b"%PDF late margin", None)), date(2026, 4, 14), now(), options, batch=1)
    assert (again.counters[0].skipped, again.counters[0].fetched, again.counters[0].failed) == (2, 1, 0)
    assert store.table("scraper_checkpoints").first().last_run_date == date(2026, 4, 14)
    assert store.table("circular_assets").count() == 3
    assert index(store, now(), options) == (3, 0) and index(store, now(), options) == (0, 0)
    chunks = store.table("chunks")
    assert chunks.schema.names == CHUNKS.names
    hits = [r.circular_id for r in Q.search(chunks, "margin").collect()]
    assert sorted(hits) == ["D1", "D3"] and Q.search(chunks, "margin", {"source": []}).count() == 0
    assert [r.circular_id for r in Q.search_index(X.inverted(chunks), chunks, "margin").collect()] == hits
    assert "<mark>margin</mark>" in Q.response(Q.search(chunks, "margin framework update"), "margin framework").first().preview
    with pytest.raises(ValueError, match="empty"):
        Q.search(chunks, "  ")
    with pytest.raises(ValueError, match="no record"):
        index(store, now(), options, record_id="nobody")
    # a record indexed anew with larger chunks loses its old ones
    two = store.table("circulars").where("circular_id = 'D2'").first().id
    before = chunks.where("circular_id = 'D2'").count()
    assert index(store, now(), Options(storage_path=options.storage_path), record_id=two) == (1, 0)
    assert before > 1 and store.table("chunks").where("circular_id = 'D2'").count() == 1
    reset(store, index_state=True, bloom=True, chunks=True)
    assert store.table("chunks").count() == 0 and store.table("circulars").where("es_indexed_at IS NOT NULL").count() == 0


def test_upserts_and_stale_chunks(spark):
    schema = "chunk_id string, circular_db_id string, n int"
    old = spark.createDataFrame([("a", "r", 1), ("b", "r", 1), ("c", "s", 1)], schema)
    new = spark.createDataFrame([("a", "r", 2), ("d", "r", 2)], schema)
    kept = X.upserted(old, new)
    assert sorted(tuple(r) for r in kept.collect()) == [("a", "r", 2), ("b", "r", 1), ("c", "s", 1), ("d", "r", 2)]
    ids = spark.createDataFrame([("r",)], "id string")
    assert [r.chunk_id for r in X.stale(kept, ids, new).collect()] == ["b"]
    assert sorted(r.chunk_id for r in X.stale(kept, ids, new.limit(0)).collect()) == ["a", "b", "d"]
    assert X.without_record(kept, "r").count() == 1 and X.without(kept, X.stale(kept, ids, new)).count() == 3
    assert X.decoded(spark.createDataFrame([("x", "2026-04-01")], "chunk_id string, issue_date string")).first().asset_id == ""


def test_stream(spark, tmp_path):
    store, options = Store(spark, str(tmp_path / "store")), Options(storage_path=str(tmp_path / "raw"))
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "one.json").write_text(payload(1, 2))
    run = lambda: start(store, str(tmp_path / "landed"), str(tmp_path / "mark"), lambda d: d.select("source", "circular_id", F.lit(b"%PDF x").alias("content"), F.lit(None).cast("string").alias("error")), lambda: date(2026, 4, 14), now, options).awaitTermination()
    run()
    (tmp_path / "landed" / "two.json").write_text(payload(2, 3))
    run()
    assert sorted((r.circular_id, r.status) for r in store.table("circulars").collect()) == [("D1", "FETCHED"), ("D2", "FETCHED"), ("D3", "FETCHED")]


def test_running_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("detected_at"), F.col("event_type").alias("source"))
    assert running_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_command_line(tmp_path):
    args = cli.parser().parse_args(["--store", "s", "index", "--batch-size", "3", "--reset-db"])
    assert args.batch_size == 3 and args.reset_db and not args.delete_index
    assert cli.main(["--store", "s", "schema", str(tmp_path / "x.sql")]) == 0


def test_sources_choice():
    assert Q.selected_sources("All") == ["NSE", "SEBI"] and Q.selected_sources("NSE") == ["NSE"]


def plain(rows):
    def one(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "-"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v).removesuffix(" 00:00:00")

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(P.ORACLE))
def test_query(spark, sf_dir, name):
    got = P.QUERIES[name](spark, sf_dir).toPandas().astype(object)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(P.ORACLE[name]).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert plain(got[order].itertuples(index=False)) == plain(want[order].itertuples(index=False))


def test_entry_without_the_optional_part(spark, monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    assert set(P.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("gazetta.llm")] + ["gazetta.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    again = importlib.import_module("__spark_entry__")
    assert set(again.queries()) == set(P.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)


def test_texts_of_assets_are_matched_once(spark, sf_dir):
    from gazetta.plans import queries

    plan = queries.p8_index_documents(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(",")[0].split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert keys and not [k for k in keys if k.startswith("asset_id#")]  # by the record's id only
    records, assets = queries.adapted(spark, sf_dir, "circulars", "assets")
    texts = assets.where("id LIKE '%1'").selectExpr("id AS asset_id", "repeat(id, 400) AS text")
    own = assets.join(texts, assets.id == texts.asset_id).drop("asset_id")
    columns = ["chunk_id", "circular_db_id", "asset_id", "content_hash", "chunk_index", "chunk_text"]
    want = X.documents(records, assets, texts, queries.now()).select(*columns).collect()
    assert len(want) > 100 and sorted(want) == sorted(X.documents(records, own, None, queries.now()).select(*columns).collect())
