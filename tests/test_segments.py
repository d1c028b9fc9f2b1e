"""The stored index and state: segments, buckets, places of files, files written whole."""

import json
import random
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gazetta import cli
from gazetta.operators import index as X
from gazetta.operators import search as Q
from gazetta.operators import segments as G
from gazetta.operators import state as S
from gazetta.options import Options
from gazetta.plans.ingest import index, ingest
from gazetta.schemas import CIRCULARS
from gazetta.sources import html_feed as H
from gazetta.sources import json_feed as J
from gazetta.sources.archives import directory, member_contents, unpacked
from gazetta.sources.assets import contents, land, qualified
from gazetta.store import Conflict, Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't see this module

SCHEMA = "chunk_id string, circular_db_id string, chunk_index int, chunk_text string, source string"
WORDS = "the of margin framework update members rule notice fund risk".split()


def now():
    return F.expr("TIMESTAMP '2026-04-14 12:00:00'")


def batch(rng, records, version):
    out = []
    for r in records:
        for k in range(rng.randint(1, 4)):
            n = rng.randint(0, 30)
            text = " ".join(rng.choice(WORDS[: 2 + r % 9]) for _ in range(n)) or " - "
            out.append((f"{r}:{k}:{version if rng.random() < 0.5 else 0}", f"r{r}", k, text, f"s{r % 3}"))
    return out


def score_rows(df):
    return [(r.chunk_id, round(r.score, 9)) for r in df.collect()]


def test_index_after_changes_equals_one_built_anew(spark, tmp_path, monkeypatch):
    rng, live = random.Random(2), {}
    ix = G.Index(spark, spark.createDataFrame([], SCHEMA).schema)
    merged = 0
    for version, (records, stale) in enumerate([(range(200), False), (range(5), True), (range(50, 60), False), (range(300, 303), False), (range(2), True), ([], False)]):
        rows = batch(rng, records, version)
        new = spark.createDataFrame(rows, SCHEMA)
        ids = spark.createDataFrame([(f"r{r}",) for r in records], "id string")
        if stale:
            live = {k: v for k, v in live.items() if v[1] not in {f"r{r}" for r in records}}
        live |= {r[0]: r for r in rows}
        before = len(ix.segments)
        ix = ix.updated(new, str(tmp_path / "ix"), ids if stale else None, fanout=3)
        merged += len(ix.segments) <= before and bool(rows)
        assert ix.n == len(live) and len(ix.segments) < 3 + 2
    assert merged and sorted(tuple(r) for r in ix.chunks().collect()) == sorted(live.values())
    ix = G.Index.of(spark, ix.columns, json.loads(json.dumps(ix.told())))
    final = spark.createDataFrame(list(live.values()), SCHEMA)
    assert sorted(ix.terms().collect()) == sorted(X.inverted(final).terms.collect())
    assert abs(ix.average - X.totals(final).first().average) < 1e-9
    monkeypatch.setattr(G, "FREQUENT", 3)
    short = ix.updated(spark.createDataFrame([("new", "r999", 0, "alpha beta beta gamma gamma gamma delta", "s")], SCHEMA), str(tmp_path / "ix"), fanout=99)
    exact = {r.term: r.cf for r in short.terms().collect()}
    assert short.segments[-1].floor == 1 and all(r.least <= exact[r.term] <= r.most for r in short.frequent(100).collect())
    told = ix.summary().first()
    assert told.n == len(live) and abs(told.distinct - len({v[3] for v in live.values()})) < 0.3 * told.distinct and len(told.lengths) == 3
    assert G.Index(spark, ix.columns).summary().first().lengths is None and G.Index(spark, ix.columns).frequent().count() == 0
    fewer = 0
    for query, filters, size in [("margin rule", None, 5), ("the the of", None, 40), ("risk", None, 1000), ("nowhere", None, 5), ("fund notice of", {"source": ["s1"]}, 7), ("the", {"source": []}, 7), ("the", {"source": None}, 3), ("risk fund notice", None, 3)]:
        found = G.top(ix, query, filters, size)
        assert score_rows(found.hits) == score_rows(Q.search(final, query, filters, size))
        assert found.read <= found.blocks
        fewer += found.read < found.blocks
    assert fewer
    gone = ix.without_records(spark.createDataFrame([("r7",), ("r301",), ("nobody",)], "id string"), str(tmp_path / "ix"))
    assert gone.n == sum(v[1] not in ("r7", "r301") for v in live.values()) == gone.chunks().count()
    with pytest.raises(ValueError, match="empty"):
        G.top(ix, " ")
    assert G.top(G.Index(spark, ix.columns), "the").hits.count() == 0


def test_equal_scores_beyond_the_size(spark, tmp_path):
    rows = [(f"c{i:04d}", f"r{i}", 0, "margin rule" if i % 3 else "margin", "s") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    ix = G.Index(spark, df.schema).updated(df, str(tmp_path / "ix"))
    assert score_rows(G.top(ix, "margin", size=20).hits) == score_rows(Q.search(df, "margin", size=20))
    assert G.due(tuple(G.Segment("", "", n, n, 1, 1, 0) for n in (100_000, 250, 200, 100, 5)), 4) == 1
    assert G.due(tuple(G.Segment("", "", n, n, 1, 1, 0) for n in (100_000, 200, 100, 5)), 4) is None and G.due((), 2) is None


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=512)
    base = {f.name: None for f in CIRCULARS}
    rows = [base | {"id": f"id{i}", "source": "NSE", "circular_id": f"C{i}", "source_item_key": f"k{i}", "title": "old", "status": "FETCHED"} for i in range(3000)]
    state = spark.createDataFrame(rows, CIRCULARS)
    store.publish({"circulars": state})
    items = [base | {"source": "NSE", "circular_id": f"C{i}" if i % 2 else f"new{i}", "source_item_key": f"k{i}" if i % 3 else f"other{i}", "title": "new"} for i in range(0, 500, 10)]
    found = spark.createDataFrame([{k: v for k, v in r.items() if k not in ("id", "status")} | {"pos": i} for i, r in enumerate(items)], "source string, circular_id string, source_item_key string, full_reference string, department string, title string, issue_date date, effective_date date, url string, pdf_url string, detected_at timestamp, pos int, error_message string")
    own, rejected = S.targeted(store.table("circulars"), found)
    touched = store.touched(own.select("id"))
    part = S.merged(store.table("circulars", touched), own, rejected, now())
    store.publish({"circulars": part.state}, touched=touched)
    written = list((tmp_path / "store" / "v=2").rglob("bucket=*"))
    assert 0 < len(written) <= len(touched) <= 50
    whole = S.merge(state, found, now())
    assert sorted(map(str, store.table("circulars").collect())) == sorted(map(str, whole.state.collect()))
    assert sorted(map(str, part.applied.collect())) == sorted(map(str, whole.applied.collect()))
    with pytest.raises(Conflict):
        store.publish({"circulars": state}, base=1)
    assert store.version() == 2
    # a touched bucket that has no rows any more
    store.publish({"circulars": store.table("circulars", touched).limit(0)}, touched=touched)
    assert store.table("circulars").where(store.bucket("id").isin(touched)).count() == 0 and store.table("circulars").count() > 0
    before = store.table("circulars").count()
    store.rebucket(8)
    assert store.buckets == 8 and store.table("circulars").count() == before and store.touched(state.select("id")) == list(range(8))


@pytest.mark.parametrize("root", ["data/raw", "{}/raw files [1]", "file://{}/raw", "file:{}/raw"])
def test_indexing_finds_files_wherever_they_are(spark, tmp_path, root):
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    old = fs.getWorkingDirectory()
    fs.setWorkingDirectory(path(str(tmp_path)))
    try:
        store, options = Store(spark, str(tmp_path / "store"), buckets=4), Options(storage_path=root.format(tmp_path))
        assert Options().storage_path == "data/raw"
        payload = json.dumps({"data": [{"fileExt": "pdf", "fileDept": "D", "circNumber": str(n), "cirDate": f"202604{n:02d}", "circDisplayNo": "", "sub": "t", "circFilelink": "u"} for n in (1, 2)]})
        found = J.detected(spark.createDataFrame([("f", payload)], "file string, payload string"), now())
        loaded = spark.createDataFrame([("NSE", f"D{n}", b"%PDF margin", None) for n in (1, 2)], "source string, circular_id string, content binary, error string")
        assert [tuple(r)[1:4] for r in ingest(store, found, loaded, date(2026, 4, 14), now(), options).counters] == [(2, 0, 2)]
        assert store.table("circular_assets").first().file_path.startswith(root.format(tmp_path))
        one = store.table("circular_assets").where("file_path LIKE '%D2/%'")
        assert [bytes(r.content) for r in contents(one).collect()] == [b"%PDF margin"]
        assert index(store, now(), options) == (2, 0)
        assert {r.circular_id for r in G.top(store.index(), "margin").hits.collect()} == {"D1", "D2"}
        assert sorted(p.name for p in tmp_path.rglob("source.pdf")) == ["source.pdf"] * 2 and not list(tmp_path.rglob(".staged*"))
    finally:
        fs.setWorkingDirectory(old)


def test_paths(spark):
    df = spark.createDataFrame([("/a b",), ("file:///a",), ("file:/a",), ("s3a://b/k",), (None,)], "p string")
    assert [r[0] for r in df.select(qualified(spark, "p")).collect()] == ["file:/a b", "file:/a", "file:/a", "s3a://b/k", None]
    assert contents(spark.createDataFrame([("a", "/nowhere/x.pdf"), ("b", None)], "id string, file_path string")).count() == 0


def test_files_are_seen_whole_or_not_at_all(spark, tmp_path):
    names = [f"{tmp_path}/S/2026/04/C{c}/original/{k}.pdf" for c in range(3) for k in range(4)]
    files = lambda text: spark.createDataFrame([(n, text) for n in names], "file_path string, content binary")
    land(files(b"old"), str(tmp_path / "S"))
    broken = F.udf(lambda p, c: c if "C2/original/3" not in p else 1 / 0, "binary")
    with pytest.raises(Exception, match="division"):
        land(files(b"new").withColumn("content", broken("file_path", "content")), str(tmp_path / "S"))
    assert sorted(str(p) for p in tmp_path.rglob("*") if p.is_file()) == sorted(names) and {Path(n).read_bytes() for n in names} == {b"old"}
    land(files(b"new").where("file_path LIKE '%C1%0.pdf'"))
    assert sorted(p.name for p in (tmp_path / "S/2026/04/C1").rglob("*") if p.is_file()) == ["0.pdf"] and Path(names[0]).read_bytes() == b"old"
    assert not list(tmp_path.rglob(".staged*"))


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
def test_of_two_failed_items_the_later_in_the_listing_counts(spark, order):
    long = "a-long-name-of-more-than-thirty-two-letters"
    row = "<tr role='row'>\n<td>Apr 10, 2026</td><td><a href='/{}-{}.html' target=\"_blank\" title=\"T{}\">x</a></td></tr>"
    pages = [("r", p, row.format(long, k, k) + "<a title='Next'>") for p, k in enumerate(order, 1)]
    read = H.read_pages(spark.createDataFrame(pages, "run string, page int, html string"))
    rows = H.listing_rows(read, F.lit(date(2026, 4, 1)), F.lit(date(2026, 4, 30)))
    found = H.detected(rows, spark.createDataFrame([], "detail_url string, html string, error string"), now())
    merged = S.merge(spark.createDataFrame([], CIRCULARS), found, now())
    assert [r.title for r in merged.state.collect()] == [f"T{order[1]}"] and merged.applied.first()["items"] == 2


def test_command_line_options(spark, tmp_path, capsys):
    rows = [(f"c{i}", "r", *[None] * 14, i, f"margin <b> {i}", None) for i in range(5)]
    store = Store(spark, str(tmp_path / "store"))
    new = spark.createDataFrame([dict(zip(store.index().columns.names, r, strict=True)) for r in rows], store.index().columns)
    store.publish({}, index=store.index().updated(new, store.index_path))
    args = ["--store", str(tmp_path / "store"), "--log-level", "WARNING", "search", "margin"]
    capsys.readouterr()
    assert cli.main([*args, "--size", "2", "--escape"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and "&lt;b&gt;" in out[0]


def test_archives_by_ranges(spark, tmp_path):
    import zipfile

    def archive(path, names, method=zipfile.ZIP_DEFLATED, text="text of "):
        with zipfile.ZipFile(path, "w", method) as z:
            for n in names:
                z.writestr(n, text + n)

    names = [f"d/{i:05d}.pdf" for i in range(10_000)]
    archive(tmp_path / "large.zip", names)
    archive(tmp_path / "stored.zip", ["a.PDF", "b.txt", "ü.pdf"], zipfile.ZIP_STORED)
    archive(tmp_path / "none.zip", ["b.txt"])
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04broken")
    raw = bytearray((tmp_path / "stored.zip").read_bytes())
    raw[raw.index(b"text of a.PDF")] = ord("T")
    (tmp_path / "changed.zip").write_bytes(raw)
    rows = [(x, str(tmp_path / f"{x}.zip")) for x in ("large", "stored", "none", "broken", "changed", "missing")]
    found = directory(spark.createDataFrame(rows, "archive string, path string"))
    out = member_contents(found, 16)
    tasks = out.where("archive = 'large'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 16 and max(r["count"] for r in tasks) < 1000
    got = {(r.archive, r.member): (r.position, r.content and bytes(r.content).decode(), r.error) for r in out.where("archive != 'large'").collect()}
    assert got["stored", "a.PDF"] == (1, "text of a.PDF", None) and got["stored", "ü.pdf"] == (2, "text of ü.pdf", None)
    assert got["changed", "a.PDF"] == (1, None, "checksum differs") and got["changed", "ü.pdf"][1] == "text of ü.pdf"
    assert got["none", None][2] == "ZIP archive contains no PDFs: none" and got["broken", None][2] and got["missing", None][2] and len(got) == 7
    assert out.where("archive = 'large' AND error IS NULL AND decode(content, 'UTF-8') = concat('text of ', member)").count() == 10_000
    with pytest.raises(RuntimeError, match="encrypted"):
        unpacked(b"", 8, 1, 0)
    with pytest.raises(RuntimeError, match="method 12"):
        unpacked(b"", 12, 0, 0)


def test_parts_are_tasks_and_postings_go_through_no_exchange(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "PART_CHUNKS", 40)
    rng = random.Random(5)
    df = spark.createDataFrame(batch(rng, range(100), 1), SCHEMA)
    ix = G.Index(spark, df.schema).updated(df, str(tmp_path / "ix"))
    placed = ix.placed()
    assert ix.segments[0].parts > 2 and placed.groupBy("circular_db_id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    plan = G._postings(G._by_part(placed.select("part", "block", "slot", "dl", "chunk_text"), 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning(part" in plan
    ids = spark.createDataFrame([("r7",), ("r8",)], "id string")
    assert sorted(r.chunk_id for r in ix.of_records(ids).collect()) == sorted(r.chunk_id for r in df.where("circular_db_id IN ('r7', 'r8')").collect())
    gone = ix.without_records(ids, str(tmp_path / "ix"))
    assert sorted(gone.terms().collect()) == sorted(X.inverted(df.where("circular_db_id NOT IN ('r7', 'r8')")).terms.collect())
    assert score_rows(G.top(ix, "margin rule", size=7).hits) == score_rows(Q.search(df, "margin rule", size=7))


def test_members_are_handed_on_together(spark, tmp_path, monkeypatch):
    import zipfile

    from gazetta.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(50):
            z.writestr(f"{i}.pdf", b"x" * 100 * i)
    (tmp_path / "short.zip").write_bytes(b"PK")
    monkeypatch.setattr(archives, "TOGETHER", 7)
    monkeypatch.setattr(archives, "BYTES", 9_000)
    out = member_contents(directory(spark.createDataFrame([("a", str(tmp_path / "a.zip")), ("short", str(tmp_path / "short.zip"))], "archive string, path string")), 2).collect()
    assert {r.member: len(r.content) for r in out if r.archive == "a"} == {f"{i}.pdf": 100 * i for i in range(50)}
    assert [r.member for r in out if r.archive == "short" and r.error] == [None]


def test_words_are_counted_where_the_chunk_is(spark):
    rows = [("a", "b a b c_1"), ("b", " - "), ("c", "A a"), ("c", "A a")]
    own = X.inverted(spark.createDataFrame(rows, "chunk_id string, chunk_text string"))
    assert sorted((r.chunk_id, r.term, r.tf, r.dl) for r in own.postings.collect()) == [("a", "a", 1, 4), ("a", "b", 2, 4), ("a", "c_1", 1, 4), ("c", "a", 4, 2)]
    assert sorted(tuple(r) for r in own.terms.collect()) == [("a", 2, 5), ("b", 1, 2), ("c_1", 1, 1)]
    plan = own.postings._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert keys and all(k.startswith("chunk_id#") and "term#" not in k for k in keys)


@pytest.fixture
def confs(spark):
    """Settings for a test: joins are broadcast where that is told only, and blocks go on in the next batch."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch, confs):
    monkeypatch.setattr(G, "PART_CHUNKS", 150)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 40)
    rng = random.Random(11)
    rows, other = batch(rng, range(200), 0), batch(rng, range(0, 200, 2), 1)
    old, new = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)
    stale = spark.createDataFrame([(f"r{r}",) for r in range(0, 200, 2)], "id string")
    ix = G.Index(spark, old.schema).updated(old, str(tmp_path / "ix")).updated(new, str(tmp_path / "ix"), stale)
    live = {r[0]: r for r in rows if int(r[1][1:]) % 2} | {r[0]: r for r in other}
    # more chunks are dead than rows may be broadcast, but they are in few blocks
    assert ix.segments[1].dead > 2 * G.BROADCAST_ROWS
    plan = ix.chunks()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(tuple(r) for r in ix.chunks().collect()) == sorted(live.values())
    final = X.inverted(spark.createDataFrame(list(live.values()), SCHEMA)).terms.collect()
    assert sorted(ix.terms().collect()) == sorted(final)
    plan = G._postings(ix.placed())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for s in ix.segments:
        found = G._postings(ix.placed([s]).coalesce(1).sortWithinPartitions("block", "slot"))
        stored = spark.read.parquet(f"{s.path}/postings").select(found.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, stored.collect()))
        assert stored.groupBy("term", "block").count().where("count > 1").count() == 0 and stored.select("block").distinct().count() > 2
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    assert "SortMergeJoin" in ix.chunks()._jdf.queryExecution().executedPlan().toString() and sorted(tuple(r) for r in ix.chunks().collect()) == sorted(live.values())
    whole = ix.compacted(str(tmp_path / "ix"))
    assert sorted(whole.terms().collect()) == sorted(final) and ix.chunks().count() == len(live)
    last = ix.compacted(str(tmp_path / "ix"), replacing=True)
    assert sorted(last.terms().collect()) == sorted(final) and sorted(tuple(r) for r in last.chunks().collect()) == sorted(live.values())
    assert not any(Path(s.path).exists() for s in ix.segments) and score_rows(G.top(last, "margin rule").hits) == score_rows(G.top(whole, "margin rule").hits)


def test_a_summary_keeps_one_segment_on_disk(spark, sf_dir):
    from gazetta.plans import queries
    from gazetta.session import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.rglob("*.parquet"))
    out = queries.a10_summary(spark, sf_dir)
    assert out.first().distinct_within and out.first().median_within
    left = set(shared.rglob("*.parquet")) - before
    assert left and not [p for p in left if "/batch" in str(p)] and len({p.parents[2] for p in left if p.match("*/chunks/part=*/*")}) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("chunk_text")]


def test_texts_of_some_documents_go_through_no_exchange(spark, sf_dir, monkeypatch, confs):
    from gazetta.plans import queries

    ids = spark.createDataFrame([(i,) for i in (-70, -1, 0, 63, 64, 65, 199, 10**15, 64, None)], "doc_id long")
    docs = spark.createDataFrame([(i, "x") for i in [*range(-200, 300), 10**15, 10**15 + 1, None]], "doc_id long, text string")
    for limit in (queries.G.BROADCAST_ROWS, 2):
        monkeypatch.setattr(queries.G, "BROADCAST_ROWS", limit)
        assert sorted(r.doc_id for r in queries.of_ids(docs, ids).collect()) == [-70, -1, 0, 63, 64, 65, 199, 10**15]
    monkeypatch.undo()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    own = queries.chunks(spark, sf_dir, 800, only=labels)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    whole = queries.chunks(spark, sf_dir, 800).join(labels.distinct(), "doc_id", "left_semi")
    assert sorted(map(str, own.collect())) == sorted(map(str, whole.select(own.columns).collect()))
