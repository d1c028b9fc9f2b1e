from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gazetta.operators import assets as A
from gazetta.operators import state as S
from gazetta.schemas import ASSETS, CHECKPOINTS, CIRCULARS, DETECTED, ddl, export_ddl



def now():
    return F.lit(datetime(2026, 4, 14, 12))


DAY = date(2026, 4, 12)


def record(**given):
    row = {f.name: None for f in CIRCULARS} | {"source": "SEBI", "full_reference": "r", "title": "t", "issue_date": DAY, "status": "FETCHED", "detected_at": datetime(2026, 4, 1), "created_at": datetime(2026, 4, 1), "updated_at": datetime(2026, 4, 1)}
    return row | given


def item(pos, **given):
    row = {f.name: None for f in DETECTED} | {"source": "SEBI", "full_reference": "r", "department": "", "title": "t", "issue_date": DAY, "url": "", "pdf_url": "", "detected_at": datetime(2026, 4, 14)}
    return row | given | {"pos": pos}


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def merged(spark, state, *batch):
    schema = StructType([*DETECTED.fields, StructField("pos", IntegerType())])
    return S.merge(frame(spark, state, CIRCULARS), frame(spark, batch, schema), now())


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


def test_recovery_keeps_the_row(spark):
    old = record(id="a", circular_id="SEBI_PENDING::X", source_item_key="K", status="FAILED", error_message="m", created_at=datetime(2026, 1, 1))
    out = merged(spark, [old], item(1, circular_id="REAL", source_item_key="K", pdf_url="p"))
    assert rows(out.state, "id", "circular_id", "status", "created_at") == [("a", "REAL", "FAILED", datetime(2026, 1, 1))]
    after = S.with_outcomes(out.state, spark.createDataFrame([("a", None, "/f", "h")], "id string, error string, file_path string, content_hash string"), now())
    assert rows(after, "id", "status", "error_message", "file_path") == [("a", "FETCHED", None, "/f")]


def test_new_collisions_and_conflicts(spark):
    state = [record(id="a", circular_id="A", source_item_key="KA"), record(id="b", circular_id="B", source_item_key="KB")]
    batch = [item(1, circular_id="P", source_item_key="K1", title="one"), item(2, circular_id="P", source_item_key="K2", title="two"), item(3, circular_id="B", source_item_key="KA"), item(4, circular_id="C", source_item_key=" ", url="U")]
    out = merged(spark, state, *batch)
    assert rows(out.rejected, "pos") == [(3,)]
    new = out.state.where("id NOT IN ('a', 'b')")
    assert rows(new, "circular_id", "title", "status", "source_item_key") == [("C", "t", "DISCOVERED", "U"), ("P", "two", "DISCOVERED", "K2")]
    again = merged(spark, [r.asDict() for r in out.state.collect()], *batch)
    same = [c for c in CIRCULARS.names if c != "updated_at"]
    key = lambda r: str(r[0])
    assert sorted((tuple(r[c] for c in same) for r in again.state.collect()), key=key) == sorted((tuple(r[c] for c in same) for r in out.state.collect()), key=key)


def test_skip_rule(spark):
    old = record(id="a", circular_id="A", source_item_key="K", pdf_url="p1")
    before = frame(spark, [old], CIRCULARS)
    out = merged(spark, [old], item(1, circular_id="A", source_item_key="K", pdf_url="p2"))
    assert rows(S.fetch_decision(out.state, before, out.applied), "skip") == [(True,)]
    assert rows(S.fetch_decision(out.state, before, out.applied, refetch_on_url_change=True), "skip") == [(False,)]


def test_checkpoints(spark):
    marks = [("clean", date(2026, 4, 4)), ("mixed", date(2026, 4, 10)), ("behind", date(2026, 4, 11)), ("undated", date(2026, 4, 11)), ("idle", date(2026, 1, 1))]
    old = spark.createDataFrame([(s, d, None, None, None, 0) for s, d in marks], CHECKPOINTS)
    runs = spark.createDataFrame([("clean", 0, None), ("mixed", 1, date(2026, 4, 12)), ("behind", 1, date(2026, 4, 12)), ("undated", 2, None), ("new", 1, None)], "source string, failed int, first_failed date")
    today = F.lit(date(2026, 4, 14))
    got = dict(rows(S.next_checkpoints(old, runs, today, 4, now()), "source", "last_run_date"))
    assert got == {"clean": date(2026, 4, 14), "mixed": date(2026, 4, 11), "behind": date(2026, 4, 11), "undated": date(2026, 4, 11), "idle": date(2026, 1, 1), "new": date(2026, 4, 10)}
    starts = dict(rows(S.start_dates(old, runs.select("source"), today, 7), "source", "from_date"))
    assert starts["new"] == date(2026, 4, 7) and starts["clean"] == date(2026, 4, 4)
    assert rows(S.reset_bloom(old), "es_records_processed") == [(0,)] * 5


def test_pending_and_index_state(spark):
    state = frame(spark, [record(id=str(i), circular_id=str(i), issue_date=date(2026, 1, 9 - i), es_indexed_at=datetime(2026, 2, 1) if i == 3 else None, status="FAILED" if i == 4 else "FETCHED") for i in range(6)], CIRCULARS)
    assert [r["id"] for r in S.pending(state, 3).collect()] == ["5", "2", "1"]
    done = S.mark_indexed(state, spark.createDataFrame([("5", 4)], "id string, n int"), "ix", now())
    assert rows(done.where("id = '5'"), "es_chunk_count", "es_index_name") == [(4, "ix")]
    assert [r["id"] for r in S.pending(S.clear_index_state(done), 9).collect()] == ["5", "3", "2", "1", "0"]
    assert rows(S.clear_index_state(done, spark.createDataFrame([("3",)], "id string")).where("es_indexed_at IS NOT NULL"), "id") == [("5",)]


def test_assets(spark):
    def asset(i, parent, role, path, member=None, content_hash=None):
        return (i, parent, role, path, content_hash, "application/pdf", member, 1, datetime(2026, 1, 1), datetime(2026, 1, 1))

    own = spark.createDataFrame([asset("1", "r", "extracted_pdf", "/b", "b.pdf"), asset("2", "r", "extracted_pdf", "/a", "a.pdf"), asset("3", "r", "original_zip", "/z"), asset("4", "s", "original_pdf", "/s")], ASSETS)
    assert rows(A.indexable(own), "id") == [("1",), ("2",), ("4",)]
    assert rows(A.primary(own), "circular_id", "id") == [("r", "3"), ("s", "4")]
    assert [r["id"] for r in A.listed(own).collect()] == ["3", "2", "1", "4"]
    state = spark.createDataFrame([tuple(record(id=i, circular_id=i, file_path=p)[f.name] for f in CIRCULARS) for i, p in (("r", "/x"), ("t", "/t.zip"), ("u", None))], CIRCULARS)
    assert rows(A.backfilled(own, state, now()).where("circular_id = 't'"), "asset_role", "mime_type", "file_path") == [("original_pdf", "application/pdf", "/t.zip")]
    assert A.backfilled(own, state, now()).count() == 5 and A.without_parent(own, state).count() == 3
    names = [("x", "NSE", "FA/7", "d/fa7_a.pdf"), ("x", "NSE", "FA/7", "other.pdf"), ("y", "NSE", "FA/7", "n.PDF"), ("y", "NSE", "FA/7", "n.txt"), ("z", "SEBI", "FA/7", "fa7.pdf"), ("z", "SEBI", "FA/7", "k.pdf"), ("w", "NSE", "//", "k.pdf")]
    got = A.chosen_members(spark.createDataFrame(names, "archive string, source string, circular_id string, member string"))
    assert rows(got, "archive", "member") == [("w", "k.pdf"), ("x", "d/fa7_a.pdf"), ("y", "n.PDF"), ("z", "fa7.pdf"), ("z", "k.pdf")]


def test_schema_text(tmp_path):
    text = export_ddl(tmp_path / "a" / "b.sql").read_text()
    assert text == ddl() and "CREATE TABLE IF NOT EXISTS circulars" in text and text.endswith("\n")
