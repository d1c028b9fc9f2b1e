"""HTML extraction, preference formatting, and the pipeline."""

import html
import re

import duckdb
import pytest

from gazetta.llm import html_extract, preference


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><div id="cookie-notice"><p>We use cookies on this site. Accept them all.</p></div>
<header class="site-header"><h1>My Site</h1><p>Best news</p></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><main><article><h1>Title &amp; more</h1>
<p>First para&nbsp;graph   with <b>bold</b>text &lt;3.</p><script>var t="</p>";</script><div class="ad">Buy now! Great sale.</div><p>Second.<!-- no --></p><ul><li>one<li>two</ul></article>
<aside class="sidebar"><h3>Related</h3><p>Some long related teaser text that is a sentence.</p></aside><section class="comments"><h2>Comments</h2><div class="comment"><p>Great article, I loved it.</p></div></section>
<form><p>Subscribe to our newsletter</p><input></form></main><footer>&copy; 2024 all rights</footer></body></html>"""


def test_page(model):
    assert html_extract.extract(PAGE, model) == "Title & more\nFirst para graph with boldtext <3.\nSecond.\none\ntwo"


@pytest.mark.parametrize("page", ["", None, "<", "<" * 3000, "<div>" * 3000, "</p></div>", "<script>never closed", "<!-- open", "<p class='", "a<b", "<table><tr><td><table><tr><td>x"])
def test_odd_pages(model, page):
    assert isinstance(html_extract.extract(page, model), str)


def around(body):
    return f"<html><body><article><h1>T</h1><p>Some real text is here.</p>{body}<p>More of the real text follows.</p></article></body></html>"


@pytest.mark.parametrize(
    ("body", "line"),
    [
        ("<script src=/x/>var a=1;</script>", ""), ('<script src="/x"/>var a=1;</script>', ""), ("<iframe src=https://e.com/>fallback</iframe>", ""), ("<style/>p{}</style>", ""),
        ("<canvas>no canvas", ""), ("<object data=x>no plugin", ""), ("<select><option>A<option>B", ""), ("<button>Click me", ""), ("<video>old browser", ""),
        ("<svg><svg><text>in</text></svg><text>tail</text></svg>", ""), ("<svg/>", ""), ("<p>a <svg><path d=x/></svg> b</p>", "a b"),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."), ("<button>Click me<p>After it.</p>", "After it."), ("<template><p>hidden</p></template>", ""),
        ("<div class='a b c d e f g h i j k l sidebar'><p>Related stories to read now.</p></div>", ""),
    ],
)
def test_elements_without_text(model, body, line):
    assert html_extract.extract(around(body), model) == "\n".join(x for x in ("T", "Some real text is here.", line, "More of the real text follows.") if x)


def test_long_pages_take_linear_time(model):
    import time

    for body in ("<b>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<svg>" * 20_000, "<button>" * 20_000, "<div>" * 20_000, "<p>x" * 20_000, "<table><tr><td>" * 7000):
        began = time.time()
        html_extract.extract(f"<article>{body}text</article>", model)
        assert time.time() - began < 8, body[:10]


def test_messages_are_exact(model):
    """Marginals of small trees against sums over all labellings."""
    from itertools import product
    from math import exp

    for page in ("<article><p>a b</p><p>c</p></article>", "<div class=menu><ul><li><a>x</a></ul></div><p>text here.</p>", "<aside><p>t</p></aside>"):
        tree = html_extract.parse(page)
        own = [model.potentials(f) for f in html_extract.features(tree)]
        n, total, yes = len(own), 0.0, [0.0] * len(own)
        for rest in product((0, 1), repeat=n - 1):
            y = (1, *rest)
            weight = 0.0
            for i in range(1, n):
                pair = (y[tree.parent[i]], y[i])
                weight += {(1, 1): own[i][0], (1, 0): own[i][1], (0, 0): own[i][2], (0, 1): -1e9}[pair]
            total += (p := exp(weight) if weight > -700 else 0.0)
            for i in range(n):
                yes[i] += p * y[i]
        assert model.marginals(tree) == pytest.approx([x / total for x in yes], abs=1e-6)


def test_held_out_layouts(model):
    wrong = texts = 0
    for page in html_extract.labelled_pages(150, seed=77):
        tree = html_extract.parse(page)
        keep = model.marginals(tree)
        for i, tag in enumerate(tree.tag):
            if tag == "#text" and tree.text[i].strip():
                texts += 1
                wrong += (keep[i] >= 0.5) != tree.gold[i]
    assert wrong / texts < 0.03


def test_pages_table(spark, sf_dir, model):
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner)]
        return "\n".join(x for x in lines if x)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_extract.extracted(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    odd = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_extract.extracted(odd).where("page_id = 1").collect()) == [("", 0), ("", 0)]
    assert html_extract.extracted(odd.limit(0)).count() == 0


TURNS = "pair_id long, chosen boolean, turn long, role string, text string, prompt string"


def test_preference(spark):
    rows = [
        (0, True, 1, "assistant", "é yes", "-"), (0, True, 0, "user", "a", "-"), (0, False, 0, "user", "a", "-"), (0, False, 1, "assistant", "no", "-"), (0, False, 2, "user", "why", "-"),
        (1, True, 0, "user", "x", "-"), (1, False, 0, "user", "x", "-"), (2, False, 0, None, None, "-"), (None, True, 0, "user", "x", "-"), (3, None, 0, "user", "x", "-"),
        (4, True, 0, "user", "s", "-"), (4, True, 1, "assistant", "t", "-"), (4, False, 0, "user", "s", "-"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.pair_id: r for r in preference.formatted(df).collect()}
    user = lambda x: f"<|im_start|>user\n{x}<|im_end|>\n"
    assert set(got) == {0, 1, 2, 4}
    zero = got[0]
    assert (zero.n_chosen, zero.n_rejected, zero.n_common, zero.prompt) == (2, 3, 1, user("a"))
    assert zero.rejected == "<|im_start|>assistant\nno<|im_end|>\n" + user("why")
    a, b = map(int, zero.chosen_mask.split(":"))
    assert zero.chosen[a:b] == "é yes<|im_end|>\n" and zero.rejected_mask == "22:35"
    assert (got[1].n_common, got[1].prompt, got[1].chosen, got[1].chosen_mask) == (1, user("x"), "", "")
    assert (got[2].n_chosen, got[2].n_common, got[2].prompt, got[2].rejected) == (0, 0, "", "<|im_start|>\n<|im_end|>\n")
    assert (got[4].n_common, got[4].rejected, got[4].chosen_mask) == (1, "", "22:34")
    assert preference.formatted(df.limit(0)).count() == 0


def test_preference_sql(spark, sf_dir):
    got = preference.op5_preference(spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(preference.ORACLE_SQL["op5_preference"]).df()[got.columns]
    key = "pair_id"
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
    assert (got["n_common"] > 0).mean() > 0.9 and (got["chosen"] != got["rejected"]).mean() > 0.7


def test_rejected_sides(spark):
    rows = [
        (4, 0, "user", "q"), (4, 1, "assistant", "a1"), (4, 2, "user", "r"), (4, 3, "assistant", "a2"), (4, 4, "user", "bye"), (5, 0, "user", "x"), (5, 1, "assistant", "b1"),
        (8, 0, "user", "only"), (9, 0, None, None), (9, 1, "assistant", None), (12, 1, "assistant", "alone"), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    got = {r.pair_id: r for r in preference.paired(preference.corrupted(df)).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {4, 5, 8, 9, 12}
    assert got[4].n_common == 3 and got[4].prompt == turn("user", "q") + turn("assistant", "a1") + turn("user", "r")
    assert got[4].chosen == turn("assistant", "a2") + turn("user", "bye") and got[4].rejected == turn("assistant", "b1")
    assert got[5].rejected == turn("assistant", "a2") and got[5].n_common == 1
    assert (got[8].n_common, got[8].chosen, got[8].rejected) == (1, "", "") and got[9].rejected == ""
    assert (got[12].n_common, got[12].rejected, got[12].chosen) == (0, "", turn("assistant", "alone"))
    assert preference.corrupted(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from gazetta.llm import merge_dropout

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes, stage = [docs.count()], docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, sf_dir).cache()
        assert stage.dtypes == docs.dtypes
        sizes.append(stage.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf_dir).collect()
    left = {r.doc_id: r.text for r in stage.collect()}
    assert len(out) == sizes[-1]
    vocab = merge_dropout.vocabulary()
    assert all(vocab.decode(r.ids) == left[r.doc_id] for r in out)


def test_links_in_articles_and_parts_by_role_or_in_other_languages():
    story = "".join(f"<p>Some long paragraph number {k} of the article that tells a story with many words in it.</p>" for k in range(4))
    page = lambda before, middle, after: f"<html><body>{before}<article><h1>Title of it</h1>{story}{middle}{story}</article>{after}</body></html>"
    read = lambda *parts: html_extract.extract(page(*parts), html_extract.trained())
    assert "one long link" in read("<nav><a href=/>Home</a></nav>", "<p><a href=/a>A paragraph being one long link of some words to read</a></p>", "")
    for part in ('<div role="dialog" class="x"><p>We use cookies here</p></div>', '<div class="werbung"><p>We use cookies here</p></div>', '<div class="hinweis"><p>We use cookies here</p></div>', '<div class="kommentare"><p>We use cookies here</p></div>'):
        assert "cookies" not in read(part, "", "") and "cookies" not in read("", "", part), part
        assert read(part, "", "").count("tells a story") == 8
