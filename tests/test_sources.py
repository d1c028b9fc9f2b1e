import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from gazetta.sources import assets as A
from gazetta.sources import html_feed as H
from gazetta.sources import json_feed as J
from gazetta.sources import live
from gazetta.sources.registry import Registry


def now():
    return F.expr("TIMESTAMP '2026-04-14 12:00:00'")


def notice(**given):
    return {"fileExt": "pdf", "fileDept": "faop", "circNumber": "/73629", "cirDate": "20260415", "circDisplayNo": "FAOP/73629", "sub": "s ", "circFilelink": "https://l"} | given


def found(spark, *items, **options):
    df = spark.createDataFrame([("f", json.dumps({"data": list(items)}))], "file string, payload string")
    return {r["circular_id"]: r for r in J.detected(df, now(), **options).collect()}, J.counters(df).first()


def test_json_items(spark):
    got, counts = found(spark, notice(), notice(fileExt="docx"), notice(sub="later"), notice(fileExt="ZIP", circNumber="2", circFilelink=" ", circDisplayNo=""), notice(circNumber="3", cirDate="x"))
    assert set(got) == {"FAOP73629", "FAOP2", "FAOP3"}
    one, two = got["FAOP73629"], got["FAOP2"]
    assert (one.title, one.url, one.pdf_url, one.source_item_key, one.department, one.issue_date, one.error_message) == ("s", "https://l", "https://l", "FAOP73629", "FAOP", date(2026, 4, 15), None)
    assert two.full_reference == "FAOP2" and two.url == "https://nsearchives.nseindia.com/content/circulars/FAOP2.pdf"
    assert got["FAOP3"].issue_date is None and got["FAOP3"].error_message == "malformed date: x"
    assert (counts.total, counts.supported, counts.unsupported, counts.duplicates) == (5, 3, 1, 1)
    assert J.listing_url(date(2026, 4, 1), date(2026, 4, 6)).endswith("?&fromDate=01-04-2026&toDate=06-04-2026")


def test_json_strict_date(spark):
    with pytest.raises(Exception, match="CANNOT_PARSE|INVALID"):
        found(spark, notice(cirDate="x"), strict=True)


def row(day, url, title="T &amp; t"):
    return f"<tr role='row'>\n<td>{day}</td><td><a href='{url}' target=\"_blank\" title=\"{title}\" class='p'>x</a></td></tr>"


def listing(spark):
    one = row("Mar 25, 2026", "/a.html") + row("Mar 25, 2026", "/a.html", "again") + "<a title='Next'>"
    two = row("Mar 24, 2026", "https://o.example/b.html") + row("Mar 20, 2026", "/c.html")
    pages = [("r", 1, one), ("r", 2, two), ("r", 3, row("Mar 25, 2026", "/never.html")), ("s", 1, one), ("s", 2, one), ("s", 3, two), ("e", 1, "nothing"), ("e", 2, one)]
    return spark.createDataFrame(pages, "run string, page int, html string")


def test_html_listing(spark):
    read = H.read_pages(listing(spark))
    assert sorted((r.run, r.page) for r in read.collect()) == [("r", 1), ("r", 2), ("s", 1)]
    day = lambda d: F.lit(date(2026, 3, d))
    rows = H.listing_rows(read, day(24), day(25))
    got = sorted((r.run, r.detail_url, r.title) for r in rows.collect())
    assert got == [("r", "https://o.example/b.html", "T & t"), ("r", "https://www.sebi.gov.in/a.html", "T & t"), ("s", "https://www.sebi.gov.in/a.html", "T & t")]


def test_html_details(spark):
    number = "<span>Circular No.:  </span>\n<span> HO/38/12  &amp;1 </span>"
    frame = "<iframe src='../../../web/?file=https://d.example/1.pdf'>"
    rows = [("r", f"https://x.example/p/q/{k}.html", "t", date(2026, 3, 25)) for k in "abcd"]
    details = [(rows[0][1], number + frame, None), (rows[1][1], number + '<IFRAME width=1 src="?file=">', None), (rows[2][1], None, "timed out")]
    out = H.detected(spark.createDataFrame(rows, "run string, detail_url string, title string, issue_date date"), spark.createDataFrame(details, "detail_url string, html string, error string"), now())
    got = {r.source_item_key[-6]: r for r in out.collect()}
    assert (got["a"].circular_id, got["a"].full_reference, got["a"].pdf_url, got["a"].error_message) == ("HO/38/12 &1", "HO/38/12  &1", "https://d.example/1.pdf", None)
    assert (got["b"].circular_id, got["b"].pdf_url, got["b"].error_message) == ("SEBI_PENDING::B.HTML", "", H.NO_PARTS)
    assert got["c"].error_message == "SEBI detail fetch failed: timed out" and got["d"].error_message.startswith("SEBI detail fetch failed")
    day = lambda d: F.lit(date(2026, 3, d))
    counts = H.counters(H.read_pages(listing(spark)), day(24), day(25), out)
    assert [(r.run, r.duplicates, r.failed, r.incomplete) for r in counts.where("run = 'r'").collect()] == [("r", 1, 3, True)]


def test_live_helpers():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "ok"

    assert live.with_retries(flaky, 3, 2.0, waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError, match="no"):
        live.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), 2, 0, waits.append)
    site = {1: ("s1", 2, True), 2: ("s2", 2, True), 3: ("s1", 2, True)}
    assert [p for p, _ in live.pages(lambda p: p, lambda p: site[p])] == [1, 2]
    assert [p for p, _ in live.pages(lambda p: p, lambda p: ("", 0, True))] == []
    first, later = H.listing_form(date(2026, 3, 24), date(2026, 3, 25), 1), H.listing_form(date(2026, 3, 24), date(2026, 3, 25), 3)
    assert (first["next"], first["nextValue"], later["next"], later["nextValue"], first["fromDate"]) == ("s", "1", "n", "2", "24-03-2026")
    reader = live.FeedReader({"from": "2026-04-01", "to": "2026-04-06", "feed": "json"})
    assert [p.feed for p in reader.partitions()] == ["json"]


def test_registry():
    registry = Registry()
    for n in ("nse", "SEBI"):
        registry.register(lambda n=n: object(), n)
    assert registry.names() == ["NSE", "SEBI"] and registry.get("Nse") is registry.get("NSE")
    assert registry.enabled(("sebi",)) == [registry.get("SEBI")] and len(registry.enabled()) == 2
    with pytest.raises(KeyError, match="NSE, SEBI"):
        registry.get("bse")


def archive(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, f"text of {n}")
    return out.getvalue()


def test_expansion_and_texts(spark, tmp_path):
    day = date(2026, 4, 15)
    rows = [("r1", "SEBI", "HO/1", day, "u.zip", archive("one.pdf", "nested/two.PDF", "note.txt")), ("r2", "NSE", "N/2", day, "u", b"%PDF text"), ("r3", "NSE", "N/3", day, "u", archive("a.txt")), ("r4", "NSE", "N/4", day, "u", b"PK\x03\x04broken")]
    df = spark.createDataFrame(rows, "circular_id string, source string, public_id string, issue_date date, pdf_url string, content binary")
    got = A.expanded(df, str(tmp_path)).cache()
    named = sorted((r.circular_id, r.asset_role, (r.file_path or "").removeprefix(str(tmp_path))) for r in got.where("error IS NULL").collect())
    assert named == [("r1", "extracted_pdf", "/SEBI/2026/04/HO_1/extracted/001_one.pdf"), ("r1", "extracted_pdf", "/SEBI/2026/04/HO_1/extracted/002_two.pdf"), ("r1", "original_zip", "/SEBI/2026/04/HO_1/original/source.zip"), ("r2", "original_pdf", "/NSE/2026/04/N_2/original/source.pdf")]
    assert {r.circular_id for r in got.where("error IS NOT NULL").collect()} == {"r3", "r4"}
    assert got.where("circular_id = 'r1'").select("content_hash").distinct().count() == 1
    A.land(got)
    files = A.files(spark, str(tmp_path))
    assert files.count() == 4
    parts = A.path_parts("file_path")
    assert sorted(tuple(r) for r in files.select(parts["source"], parts["month"], parts["circular"]).distinct().collect()) == [("NSE", "04", "N_2"), ("SEBI", "04", "HO_1")]
    texts = A.texts(spark.createDataFrame([("a", b" x\fy "), ("b", None)], "asset_id string, content binary")).collect()
    assert [(r.asset_id, r.text, r.error) for r in sorted(texts)] == [("a", "x\ny", None), ("b", None, "file not found")]
    held = spark.createDataFrame([("", b"z", "C", "P"), ("u", b"z", "C", "P")], "u string, c binary, i string, p string").select(A.content_or_placeholder("u", F.col("c"), F.col("i"), "p"))
    assert [bytes(r[0]) for r in held.collect()] == [b"PDF download pending for C\nSource URL: P\n", b"z"]
