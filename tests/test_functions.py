import html
import re
from html import entities
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from gazetta.functions import normalize as N
from gazetta.functions import text as T
from gazetta.options import Options, parse_sources


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column("x")).collect()]


def plain_snippets(paragraph, query, window=120, gap=80, most=3):
    text = " ".join(paragraph.split())
    low, spans = text.lower(), []
    for word in query.lower().split():
        at = low.find(word)
        while at >= 0:
            spans.append((max(0, at - window // 2), min(len(text), at + window // 2)))
            at = low.find(word, at + len(word))
    merged = []
    for left, right in sorted(spans):
        if merged and left <= merged[-1][1] + gap:
            merged[-1][1] = max(merged[-1][1], right)
        else:
            merged.append([left, right])
    cut = lambda s: re.sub(r"\s\S*$", "", re.sub(r"^\S*\s", "", s)).strip()
    return [f"...{cut(text[a:b])}..." for a, b in merged[:most]]


def test_names(spark):
    given = ["HO/(68)2026-IMD-POD-2/I/5780/2026", "..__..", "a  b\\c?.pdf."]
    assert values(spark, N.safe_name, *given) == ["HO_(68)2026-IMD-POD-2_I_5780_2026", "document", "a_b_c_.pdf"]
    assert values(spark, N.match_key, "fa/Op-73 é") == ["FAOP73"]
    assert values(spark, N.html_feed_id, " a  b c\u001cd ") == ["a b c d"]
    assert values(spark, lambda c: N.lakh_grouped(F.col(c).cast("long")), "7", "1234", "12345678", "-100000") == ["7", "1,234", "1,23,45,678", "-1,00,000"]


def test_failed_ids(spark):
    given = ["https://a.example/x/some-long-slug-of-a-notice-that-goes-on.html/", "https://a.example/", ""]
    assert values(spark, N.failed_id, *given) == ["SEBI_PENDING::SOME-LONG-SLUG-OF-A-NOTICE-THAT-", "SEBI_PENDING::DETAIL", "SEBI_PENDING::DETAIL"]


def test_dates(spark):
    assert [str(x) for x in values(spark, N.compact_date, "20260415", "2026", None)] == ["2026-04-15", "None", "None"]
    assert [str(x) for x in values(spark, N.long_date, "Mar 5, 2026", "Mar 05, 2026")] == ["2026-03-05"] * 2


@pytest.mark.parametrize("href", ["/a/b", "c.html", "../../x?y=1", "https://o.example/z", "//h.example/p", "?q", "", "#f", "/a/../b"])
def test_absolute_url(spark, href):
    base = "https://x.example/one/two/three.html?k=v"
    assert values(spark, lambda c: N.absolute_url(F.lit(base), c), href) == [urljoin(base, href)]


def test_query_value_and_references(spark):
    assert values(spark, lambda c: N.first_query_value(c, "file"), "https://x.example/?file=https%3A%2F%2Fy%2Fa+b.pdf&z", "https://x.example/?file=", "https://x.example/") == ["https://y/a b.pdf", None, None]
    assert values(spark, N.unescaped, "a &amp; &eacute; &#39;x", "plain", None) == ["a & é 'x", "plain", None]


def test_download_type(spark):
    rows = [("https://x.example/a.zip", b"%PDF-1"), ("u", b"PK\x03\x04zz"), ("https://x.example/A.ZIP?x", b"??"), (None, b"")]
    df = spark.createDataFrame(rows, "u string, c binary")
    assert [r[0] for r in df.select(N.download_type("u", "c")).collect()] == ["pdf", "zip", "zip", "pdf"]


def test_lists(spark):
    assert values(spark, N.source_list, "nse, sebi,,NSE, ") == [["NSE", "SEBI"]]
    assert values(spark, N.exchange_list, "nse,, ,sebi") == [["NSE", "", "SEBI"]]
    assert parse_sources("nse, sebi,,NSE") == ("NSE", "SEBI") and parse_sources("a,a", distinct=False) == ("A", "A") and parse_sources(None) == ()
    assert Options.from_env(env={"GAZETTA_BATCH_SIZE": "7", "GAZETTA_SOURCES": "b,a", "GAZETTA_DETAIL_RETRIES": "0"}) == Options(batch_size=7, sources=("B", "A"), detail_retries=1)


def test_chunks(spark):
    text = "abcdefghij klmnopqrst uvwxyz"
    df = spark.createDataFrame([(text,)], "x string").select(F.posexplode(T.chunk_texts("x", 10, 2)).alias("i", "t"))
    got = [tuple(r) for r in df.select("t", T.chunk_id(F.lit("NSE:1"), "i", "t")).collect()]
    assert got == [("abcdefghij", "NSE:1:0:453ba3d41b6b"), ("ij klmnopq", "NSE:1:1:22994b64bb19"), ("pqrst uvwx", "NSE:1:2:33f9c64ffb26"), ("wxyz", "NSE:1:3:6370585ce49f")]
    sizes = values(spark, lambda c: F.size(T.chunk_texts(c)), *["x" * n for n in (0, 1, 1000, 1200, 1201, 2200, 2201)], None)
    assert sizes == [0, 1, 1, 1, 2, 2, 3, 0]
    assert values(spark, lambda c: F.size(T.chunk_texts(c, 50, 10)), "alpha beta gamma delta " * 100) == [58]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError, match="chunk size"):
            T.chunk_texts("x", *bad)


def test_snippets(spark):
    cases = [("margin framework update", "margin"), ("Margin collection update for members of the exchange", "update margin"), ("premarginal note on margins only", "margin"), ("no hit here", "zzz"), ("a.b (c) a.b " * 40, "a.b (c)"), ("ab" * 400, "ab"), ("x " * 300 + "margin " + "y " * 300 + "margin", "margin x")]
    for text, query in cases:
        assert values(spark, lambda c, q=query: T.snippets(c, q), text) == [plain_snippets(text, query)], (text[:30], query)


def test_preview(spark):
    text, query = "Margin collection update for members of the exchange", "update margin"
    assert values(spark, lambda c: T.preview(c, query), text, "", "no hit " * 40) == ["<div class='preview'>...collection <mark>update</mark> for members of the...</div>", "", "<div class='preview'>" + ("no hit " * 40)[:200] + "...</div>"]
    assert values(spark, lambda c: T.preview(c, "b", escape=True), "a <i>b</i> c d") == ["<div class='preview'>...&lt;i&gt;<mark>b</mark>&lt;/i&gt; c...</div>"]
    assert values(spark, lambda c: T.highlighted(c, "é A"), "é ée a Aa") == ["<mark>é</mark> ée <mark>a</mark> Aa"]


def test_references_by_sql():
    duckdb = pytest.importorskip("duckdb")
    from gazetta.plans.queries import decoded_sql

    named = [f"a&{n}b" for n in entities.html5] + [f"&{n}" for n in entities.html5]
    given = ["&amp;&amp;&amp", "&ampx;&notit;&notin;&unknown;&;&", "x&#65;&#x41&#X1F600;&#0;&#x80;&#1;&#xD800;&#99999999999;&#x0000000041;&#;&#x;", "a\n& b&lt", "", "plain", "&&amp;amp;", *named]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INTEGER, text VARCHAR)")
    con.execute("INSERT INTO t SELECT unnest(range(len($1))), unnest($1)", [given])
    got = con.execute(f"WITH {decoded_sql('t', 'id')} SELECT text FROM decoded ORDER BY id").fetchall()
    assert [r[0] for r in got] == [html.unescape(x) for x in given]
