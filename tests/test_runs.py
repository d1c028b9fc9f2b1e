"""Sources end to end: detection, downloads, runs, stored state, details."""

import json
import sys
from datetime import date

from pyspark import cloudpickle
from pyspark.sql import functions as F

from gazetta import cli
from gazetta.functions import serialize
from gazetta.functions import text as T
from gazetta.functions.arrays import running
from gazetta.operators import details as D
from gazetta.operators import index as X
from gazetta.operators import search as Q
from gazetta.operators import state as S
from gazetta.options import Options
from gazetta.plans.ingest import index, run
from gazetta.schemas import ATTEMPTS, CHUNKS, TABLES
from gazetta.sources import html_feed as H
from gazetta.sources import live
from gazetta.sources.assets import land
from gazetta.sources.registry import SOURCES, HtmlFeed, JsonFeed
from gazetta.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't see this module

LISTED = "<tr role='row'>\n<td>Apr 10, 2026</td><td><a href='{}' target=\"_blank\" title=\"{}\">x</a></td></tr>"
PAGE = "<span>Circular No.: </span>\n<span>HO/{}</span><iframe src='/w/?file=https://d.example/{}.pdf'>"


def now():
    return F.expr("TIMESTAMP '2026-04-14 12:00:00'")


def item(n, link="https://l.example/x.pdf"):
    return {"fileExt": "pdf", "fileDept": "D", "circNumber": str(n), "cirDate": f"202604{n:02d}", "circDisplayNo": "", "sub": f"title {n}", "circFilelink": link}


def read(spark, feed, start, end):
    bodies = [(1, json.dumps({"data": [item(11), item(12, "https://l.example/broken.pdf")]}))] if feed == "json" else [(1, LISTED.format("/a.html", "A") + LISTED.format("/b.html", "B"))]
    return spark.createDataFrame([(feed, p, b) for p, b in bodies], "feed string, page int, body string")


def get_page(url):
    if url.endswith("b.html"):
        raise OSError("timed out")
    return PAGE.format(1, 1)


def get_file(url):
    if "broken" in url:
        raise OSError("gone")
    return b"%PDF margin framework for " + url.encode()


def sources():
    return [JsonFeed(read), HtmlFeed(read, get_page, Options(detail_retries=1, detail_backoff_seconds=0))]


def test_runs_of_both_sources(spark, tmp_path):
    store, options = Store(spark, str(tmp_path / "store")), Options(storage_path=str(tmp_path / "raw"), batch_size=2)
    out = run(store, sources(), date(2026, 4, 14), now(), options, get_file)
    assert set(out) == {"NSE", "SEBI"}
    got = {r.circular_id: (r.source, r.status, r.error_message) for r in store.table("circulars").collect()}
    assert got == {"D11": ("NSE", "FETCHED", None), "D12": ("NSE", "FAILED", "gone"), "HO/1": ("SEBI", "FETCHED", None), "SEBI_PENDING::B.HTML": ("SEBI", "FAILED", "SEBI detail fetch failed: timed out")}
    assert {r.source: r.last_run_date for r in store.table("scraper_checkpoints").collect()} == {"NSE": date(2026, 4, 11), "SEBI": date(2026, 4, 10)}
    assert index(store, now(), options) == (2, 0)
    (hit,) = Q.search(store.table("chunks"), "1").collect()
    assert hit.circular_id == "HO/1"
    found = D.of_hits(Q.search(store.table("chunks"), "margin"), store.table("circulars"), store.table("circular_assets")).collect()
    assert {r.circular.circular_id for r in found} == {"D11", "HO/1"} and all(len(r.assets) == 1 for r in found)
    # the failed ones are asked for again from the checkpoint on, and what a source raises stops no other
    broken = JsonFeed(lambda *_: (_ for _ in ()).throw(OSError("down")))
    assert set(run(store, [broken, sources()[1]], date(2026, 4, 15), now(), options, get_file)) == {"SEBI"}
    # only the tables that changed are written
    version = store.version()
    store.publish({"index_attempts": store.table("index_attempts")})
    assert sorted(p.name for p in (tmp_path / "store" / f"v={version + 1}").iterdir() if p.is_dir()) == ["index_attempts"]
    assert store.table("circulars").count() == 4


def test_registered_sources():
    assert SOURCES.names() == ["NSE", "SEBI"]
    assert SOURCES.get("sebi").parse_id(" HO/ 1 \n x") == "HO/ 1 x" and SOURCES.get("NSE").parse_id("d/1 ") == "D1"
    assert SOURCES.get("nse").document_url("D1") == "https://nsearchives.nseindia.com/content/circulars/D1.pdf"
    assert SOURCES.get("SEBI").document_url("H") == f"{H.BASE}/legal/circulars/H.pdf"


def test_downloads(spark):
    schema = "source string, circular_id string, pdf_url string, url string, error_message string"
    rows = [("N", "a", "u/a", "p", None), ("N", "b", "", "page", None), ("N", "c", None, None, None), ("N", "d", "broken", "p", None), ("N", "e", "u/e", "p", "unparsed"), ("N", "a", "u/a", "p", None)]
    got = {r.circular_id: (r.content and bytes(r.content), r.error) for r in live.downloads(spark.createDataFrame(rows, schema), get_file).collect()}
    assert got == {"a": (b"%PDF margin framework for u/a", None), "b": (b"PDF download pending for b\nSource URL: page\n", None), "c": (b"PDF download pending for c\nSource URL: \n", None), "d": (None, "gone")}


def test_detail_pages_are_tried_again(spark):
    rows = spark.createDataFrame([("https://x/a.html",), ("https://x/b.html",), ("https://x/a.html",)], "detail_url string")
    got = {r.detail_url[-6]: (r.html is not None, r.error) for r in live.detail_pages(rows, Options(detail_retries=2, detail_backoff_seconds=0), get_page).collect()}
    assert got == {"a": (True, None), "b": (False, "timed out")}


def test_landing_empties_a_circular_first(spark, tmp_path):
    assets = lambda *names: spark.createDataFrame([(f"{tmp_path}/S/2026/04/C/{n}", n.encode()) for n in names], "file_path string, content binary")
    land(assets("original/source.zip", "extracted/001_a.pdf", "extracted/002_b.pdf"))
    land(assets("original/source.zip", "extracted/001_c.pdf"))
    assert sorted(str(p.relative_to(tmp_path / "S/2026/04/C")) for p in tmp_path.rglob("*") if p.is_file()) == ["extracted/001_c.pdf", "original/source.zip"]


def test_what_cannot_be_indexed_keeps_no_place(spark):
    state = spark.createDataFrame([(f"r{i}", "FETCHED", None, date(2026, 1, i + 1), None) for i in range(4)], "id string, status string, es_indexed_at timestamp, issue_date date, created_at timestamp")
    attempts = spark.createDataFrame([], ATTEMPTS)
    outcomes = lambda *rows: spark.createDataFrame(rows, "id string, ok boolean, skipped_reason string")
    assert [r.id for r in S.pending(state, 2).collect()] == [r.id for r in S.pending(state, 2, attempts).collect()] == ["r0", "r1"]
    attempts = S.attempted(attempts, outcomes(("r0", False, "no text"), ("r1", True, None)), now())
    assert [(r.id, r.attempts, r.skipped_reason) for r in attempts.collect()] == [("r0", 1, "no text")]
    assert [r.id for r in S.pending(state, 4, attempts).collect()] == ["r1", "r2", "r3", "r0"]
    attempts = S.attempted(attempts, outcomes(("r0", False, "no indexable asset"), ("r2", False, "no text")), now())
    assert {r.id: (r.attempts, r.skipped_reason) for r in attempts.collect()} == {"r0": (2, "no indexable asset"), "r2": (1, "no text")}
    assert S.attempted(attempts, outcomes(("r0", True, None)), now()).count() == 1


def test_upserts_with_ties(spark):
    schema = "chunk_id string, chunk_index int, chunk_text string"
    old = spark.createDataFrame([("a", 9, "old"), ("z", 1, "kept")], schema)
    new = spark.createDataFrame([("a", 0, "first"), ("a", 2, "last"), ("a", 1, "middle"), ("b", 0, "x"), ("b", 0, "y")], schema)
    for k in (1, 3, 5):
        got = {r.chunk_id: (r.chunk_index, r.chunk_text) for r in X.upserted(old, new.repartition(k)).collect()}
        assert got == {"a": (2, "last"), "b": (0, "y"), "z": (1, "kept")}
    stored = X.upserted(old, new)
    assert X.upsert_counts(new, stored).first() == (2, 0, True)
    assert X.upsert_counts(new, stored.where("chunk_id != 'b'")).first() == (1, 1, False)
    assert X.upsert_counts(new.limit(0), stored).first() == (0, 0, True)


def test_stored_index(spark, tmp_path):
    rows = [(f"c{i:03d}", "r", f"word{i % 7} the the margin" if i % 3 else "the framework") for i in range(200)] + [("e", "r", " - ")]
    chunks = spark.createDataFrame(rows, "chunk_id string, circular_db_id string, chunk_text string")
    own = X.save_inverted(X.inverted(chunks), str(tmp_path / "ix"), 4)
    for query, filters in (("the margin word3", None), ("framework", None), ("the", {"chunk_id": ["c001", "c003"]}), ("nowhere", None), ("the", {"circular_db_id": None})):
        want = [(r.chunk_id, round(r.score, 9)) for r in Q.search(chunks, query, filters).collect()]
        assert [(r.chunk_id, round(r.score, 9)) for r in Q.search_index(own, chunks, query, filters).collect()] == want
    assert own.totals.first().n == 201 and own.postings.where("term = 'the'").count() == 200


def test_stored_postings_go_through_no_exchange(spark, tmp_path, monkeypatch):
    rows = [(f"c{i:03d}", f"word{i % 7} the the margin" if i % 3 else "the framework") for i in range(100)] + [("e", " - "), ("c001", "word1 the the margin"), ("n", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_text string").repartition(6)

    def refused(*_):
        raise AssertionError("postings are dealt anew")

    monkeypatch.setattr(type(chunks), "repartitionByRange", refused)
    own = X.save_inverted(X.inverted(chunks), str(tmp_path / "ix"), 2)
    assert sorted(own.postings.collect()) == sorted(X.inverted(chunks).postings.collect())
    assert sorted(own.terms.collect()) == sorted(X.inverted(chunks).terms.collect())
    assert own.totals.collect() == X.inverted(chunks).totals.collect() and own.totals.dtypes == X.inverted(chunks).totals.dtypes
    files = sorted((tmp_path / "ix" / "postings").glob("*.parquet"))
    assert 0 < len(files) <= 2
    for f in files:  # as written, whatever the order of reading
        terms = [r.term for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert terms == sorted(terms)
    none = X.save_inverted(X.inverted(chunks.limit(0)), str(tmp_path / "none"), 2)
    assert [tuple(r) for r in none.totals.collect()] == [(0, None)]


def test_running_values_and_long_texts(spark):
    one = spark.range(1)
    for n in (0, 1, 2, 3, 1000):
        numbers = F.slice(F.sequence(F.lit(1), F.lit(1000)), 1, n)
        assert one.select(running(numbers).alias("x")).first().x == [k * (k + 1) // 2 for k in range(1, n + 1)]
        assert one.select(running(F.transform(numbers, lambda k: k * 7 % 11), F.greatest).alias("x")).first().x == [max(j * 7 % 11 for j in range(1, k + 1)) for k in range(1, n + 1)]
    text = " ".join(f"w{i}é" for i in range(30_000))
    want = [c for p in range(0, max(len(text) - 200 - 1, 0) + 1, 1000) if (c := text[p : p + 1200].strip())]
    df = spark.createDataFrame([(text,), (None,), ("",), ("x" * 1200,), ("x" * 1201,), ("y " * 20_000,)], "t string")
    sizes = [r.c for r in df.select(T.chunk_texts("t").alias("c")).collect()]
    assert sizes[0] == want and [len(c) for c in sizes[1:5]] == [0, 0, 1, 2]
    found = df.select(T.snippets("t", "w3é y").alias("s")).collect()
    assert len(found[0].s) == 1 and len(found[5].s) == 1 and found[1].s == []


def test_details_and_json(spark):
    records = spark.createDataFrame([("r1", None), ("r2", "k")], "id string, source_item_key string").selectExpr("id", "source_item_key", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in TABLES["circulars"] if f.name not in ("id", "source_item_key")])
    kinds = [("a", "extracted_pdf", "b.pdf"), ("b", "original_zip", None), ("c", "extracted_pdf", "a.pdf")]
    assets = spark.createDataFrame([(i, "r1", role, m) for i, role, m in kinds], "id string, circular_id string, asset_role string, archive_member_path string").selectExpr("*", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in TABLES["circular_assets"] if f.name not in ("id", "circular_id", "asset_role", "archive_member_path")])
    found = {r.circular.id: [a.id for a in r.assets] for r in D.details(records, assets).collect()}
    assert found == {"r1": ["b", "c", "a"], "r2": []} and D.detail(records, assets, "none").count() == 0
    told = json.loads(records.where("id = 'r1'").select(serialize.record_json()).first()[0])
    assert told["source_item_key"] == "" and told["file_path"] is None and set(told) == set(TABLES["circulars"].names)
    assert set(json.loads(spark.createDataFrame([(None,) * len(CHUNKS)], CHUNKS).select(serialize.chunk_json()).first()[0])) == set(CHUNKS.names)


def test_command_line_with_landed_pages(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("GAZETTA_STORAGE_PATH", str(tmp_path / "raw"))
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "page-1.html").write_text(LISTED.format("/a.html", "A") + LISTED.format("/b.html", "B"))
    (tmp_path / "details.json").write_text(json.dumps({"detail_url": f"{H.BASE}/a.html", "html": PAGE.format(1, 1)}))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "HO_1.pdf").write_bytes(b"%PDF margin text")
    store = ["--store", str(tmp_path / "store"), "--log-level", "WARNING"]
    assert cli.main([*store, "ingest", "--feed", "html", "--landed", str(tmp_path / "html"), "--details", str(tmp_path / "details.json"), "--files", str(tmp_path / "files")]) == 0
    records = Store(spark, str(tmp_path / "store")).table("circulars").collect()
    assert {r.circular_id: r.status for r in records} == {"HO/1": "FETCHED", "SEBI_PENDING::B.HTML": "FAILED"}
    assert cli.main([*store, "index", "--setup-index"]) == 0 and cli.main([*store, "index"]) == 0
    capsys.readouterr()
    assert cli.main([*store, "search", "margin"]) == 0 and "<mark>margin</mark>" in capsys.readouterr().out
    one = next(r.id for r in records if r.status == "FETCHED")
    assert cli.main([*store, "record", one]) == 0 and json.loads(capsys.readouterr().out)["assets"][0]["asset_role"] == "original_pdf"
    assert cli.main([*store, "record", "nobody"]) == 1
