"""Main text of web pages by a tree-structured graphical model.

The elements and texts of a page are the nodes of a Markov random field over its
DOM tree, each content or not. A node's potential comes from its tag, the words of
its class, id and role, those of its parent, and its share of link text; it joins the
node to its parent, since a part that isn't content holds none. The potentials are
learned from labelled pages. Sum-product message passing, once up and once down the
tree, gives the exact probability of each node, and texts that are likelier content
than not are kept.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gazetta.llm.common import lean, table

#: Fixed values of HTML: elements that break a line of text, that have no content, whose content isn't markup and no
#: text of the page, whose content is markup that isn't shown as text, and that end where others begin.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta mprescripts mspace none param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
UNSEEN = frozenset("annotation annotation-xml audio button canvas datalist object select svg template video".split())
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "optgroup", "option"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}

#: Labelled pages to learn from, and the seed that makes them.
PAGES, SEED = 500, 11
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|data-gold)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Where the content of an unseen element ends that is never closed: at the next element that breaks a line.
_BREAK = re.compile(rf"<(?:/?(?:{'|'.join(sorted(BLOCKS - {'option', 'optgroup'}))})|button)(?![\w-])|\Z", re.I)
_HEAD_END = re.compile(r"</head\b[^>]*>|(?=<(?:body|article|div|p|h1|main)\b)", re.I)
_CELLS = frozenset("td th tr tbody thead tfoot".split())


class Tree:
    """Nodes of a page in page order, parents first."""

    __slots__ = ("attrs", "gold", "parent", "tag", "text")

    def __init__(self) -> None:
        self.tag: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.text: list[str | None] = [None]
        self.attrs: list[tuple[str, ...]] = [()]
        self.gold: list[bool] = [False]

    def add(self, tag: str, parent: int, text: str | None = None, attrs: str = "") -> int:
        words, gold = {}, False
        for name, value in _ATTR.findall(attrs) if attrs else ():
            if name == "data-gold":
                gold = True
            else:
                words |= dict.fromkeys(w.lower() for w in _PART.findall(value))
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.attrs.append(tuple(words))
        self.gold.append(gold or self.gold[parent])
        return len(self.tag) - 1


class _Open:
    """Elements that are open: their nodes, and the places of each tag and of line-breaking elements among them, so that none is searched for."""

    def __init__(self, tree: Tree) -> None:
        self.tree, self.nodes = tree, [0]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int) -> None:
        tag = self.tree.tag[node]
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            tag = self.tree.tag[self.nodes.pop()]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """What an end tag does: an inline element ends in its own block only."""
        places = self.places.get(tag)
        if places and (tag in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):
            self.cut(places[-1])

    def begin(self, tag: str) -> None:
        """Ends the elements that end where tag begins."""
        k = len(self.blocks) - 1
        while k >= 0:
            own = self.tree.tag[self.nodes[self.blocks[k]]]
            if tag in CLOSED_BY.get(own, ()):
                self.cut(self.blocks[k])
                k = len(self.blocks) - 1
            elif own in _CELLS and tag in _CELLS:
                k -= 1
            else:
                return


def parse(page: str) -> Tree:
    """The tree of a page; elements left open end with what they are in."""
    tree, at = Tree(), 0
    opened = _Open(tree)
    matches: dict[str, dict[int, int]] = {}
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if (c := m[0]) and (c[0] != "<" or len(c) == 1):
                tree.add("#text", opened.nodes[-1], html.unescape(c))
            continue
        tag, attrs = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            opened.close(tag)
        elif tag == "head":
            at = end.end() if (end := _HEAD_END.search(page, at)) else at
        elif tag in RAW:
            at = _after(page, at, tag)
        elif tag in UNSEEN:
            if tag not in matches:
                matches[tag] = _matches(page, tag)
            if not (tag == "svg" and attrs.endswith("/")):  # a slash closes nothing else
                at = matches[tag].get(m.start()) or _BREAK.search(page, at).start()
        elif tag not in ("html", "body"):
            opened.begin(tag)
            if tag in VOID:
                tree.add(tag, opened.nodes[-1], " " if tag == "br" else None)
            else:
                opened.push(tree.add(tag, opened.nodes[-1], None, attrs))
    return tree


def _after(page: str, at: int, tag: str) -> int:
    """Where an element ends whose content isn't markup: behind its first end tag."""
    end = _end_of(tag).search(page, at)
    return end.end() if end else len(page)


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![\w-])[^>]*>", re.I)


@lru_cache(maxsize=64)
def _either_of(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?![\w-])[^>]*>", re.I)


def _matches(page: str, tag: str) -> dict[int, int]:
    """For the start of each element of a tag, the place behind its end tag, nested ones counted; those never closed are left out."""
    out, starts = {}, []
    for m in _either_of(tag).finditer(page):
        if not m[1]:
            if not (tag == "svg" and m[0].endswith("/>")):
                starts.append(m.start())
        elif starts:
            out[starts.pop()] = m.end()
    return out


def features(tree: Tree) -> list[list[str]]:
    """Names of what each node shows of itself."""
    n = len(tree.tag)
    chars, links = [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
        if tree.text[i]:
            chars[i] = len(tree.text[i])
            links[i] = chars[i] if linked[i] else 0
    for i in range(n - 1, 0, -1):
        chars[tree.parent[i]] += chars[i]
        links[tree.parent[i]] += links[i]
    out = []
    for i in range(n):
        up = tree.tag[tree.parent[i]] if i else "-"
        own = ["-", f"t={tree.tag[i]}", f"p={up}", f"tp={tree.tag[i]} {up}", f"l={min(3, int(4 * links[i] / chars[i])) if chars[i] else 0}"]
        if tree.tag[i] != "#text":
            own += [f"a={w}" for w in tree.attrs[i]]
        if i:
            own.append(f"pl={min(3, int(4 * links[tree.parent[i]] / chars[tree.parent[i]])) if chars[tree.parent[i]] else 0} {tree.tag[i] == 'a'}")
        own += [f"pa={w}" for w in tree.attrs[tree.parent[i]]] if i else []
        out.append(own)
    return out


#: What a node and its parent can be: (parent, node) content or not. Content is never in what isn't.
STATES = ((True, True), (True, False), (False, False))


class Model:
    """Potentials of (parent, node) from the node's features: weights by feature and state, and the log share of content parents."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], parents: tuple[float, float]):
        self.weights, self.parents = weights, parents
        self.kept: dict[tuple[str, ...], tuple[float, float, float]] = {}

    def potentials(self, own: list[str]) -> tuple[float, float, float]:
        """Of the three states; a scaled likelihood, so a node that tells nothing weighs nothing. Nodes look alike, so they are kept."""
        key = tuple(own)
        if (known := self.kept.get(key)) is None:
            if len(self.kept) >= 100_000:
                self.kept = {}
            known = self.kept[key] = self._potentials(key)
        return known

    def _potentials(self, own: tuple[str, ...]) -> tuple[float, float, float]:
        found = [w for f in own if (w := self.weights.get(f))]
        a, b, c = (sum([w[k] for w in found]) for k in range(3))
        total = _log_sum(_log_sum(a, b), c)
        yes, no = self.parents
        return a - total - yes, b - total - yes, c - total - no

    def marginals(self, tree: Tree) -> list[float]:
        """Probability that each node is content: sum-product up the tree, then down. The root is content."""
        n = len(tree.tag)
        own = [(0.0, 0.0, 0.0)] + [self.potentials(f) for f in features(tree)[1:]]
        up0, up1 = [0.0] * n, [0.0] * n
        said = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c = own[i]
            said[i] = c + up0[i], _log_sum(b + up0[i], a + up1[i])
            up0[tree.parent[i]] += said[i][0]
            up1[tree.parent[i]] += said[i][1]
        up0[0], up1[0] = up1[0] - 50.0, up1[0]
        out = [1.0] * n
        for i in range(1, n):
            p = tree.parent[i]
            a, b, c = own[i]
            x0, x1 = up0[p] - said[i][0], up1[p] - said[i][1]
            up0[i] += _log_sum(x0 + c, x1 + b)
            up1[i] += x1 + a
            out[i] = _share(up1[i] - up0[i])
        return out


def _log_sum(x: float, y: float) -> float:
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def _share(odds: float) -> float:
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def train(pages: list[str], rounds: int = 250, rate: float = 0.5, decay: float = 2e-4) -> Model:
    """Softmax regression of the states over labelled pages: elements with data-gold, and what is in them, are content, and so is what holds content."""
    names: dict[str, int] = {}
    counts: Counter = Counter()
    for page in pages:
        tree = parse(page)
        label = [g and (t != "#text" or bool((x or "").strip())) for g, t, x in zip(tree.gold, tree.tag, tree.text, strict=True)]
        for i in range(len(label) - 1, 0, -1):
            label[tree.parent[i]] |= label[i]
        for i, own in enumerate(features(tree)):
            if i and (tree.tag[i] != "#text" or tree.text[i].strip()):
                counts[tuple(names.setdefault(f, len(names)) for f in own), STATES.index((label[tree.parent[i]], label[i]))] += 1
    x = np.zeros((len(counts), len(names)), np.float32)
    for i, (own, _) in enumerate(counts):
        x[i, list(own)] = 1
    y = np.eye(3, dtype=np.float32)[[state for _, state in counts]]
    times = np.fromiter(counts.values(), np.float32, len(counts))[:, None]
    size = np.sqrt((x * times).sum(0) * times.sum())[:, None]
    w = np.zeros((len(names), 3), np.float32)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        # steps for rare features are as large as for frequent ones
        grad = x.T @ ((p - y) * times) / size + decay * w
        speed = 0.9 * speed - rate * grad
        w += speed
    no = float((y[:, 2:] * times).sum() / times.sum())
    return Model({f: tuple(map(float, w[k])) for f, k in names.items()}, (math.log(1 - no), math.log(no)))


def extract(page: str | None, model: Model) -> str:
    """The texts likelier content than not: white space inside a block is one space, blocks are lines."""
    if not page:
        return ""
    tree = parse(page)
    keep = model.marginals(tree)
    lines, line, n = [], [], len(tree.tag)
    ends: list[int] = []  # last nodes of open blocks
    last = list(range(n))
    for i in range(n - 1, 0, -1):
        last[tree.parent[i]] = max(last[tree.parent[i]], last[i])

    def flush() -> None:
        if words := "".join(line).split():
            lines.append(" ".join(words))
        line.clear()

    for i in range(1, n):
        while ends and i > ends[-1]:
            ends.pop()
            flush()
        if tree.tag[i] in BLOCKS:
            flush()
            ends.append(last[i])
        elif tree.text[i] and (keep[i] >= 0.5 or tree.tag[i] == "br"):
            line.append(tree.text[i])
    flush()
    return "\n".join(lines)


#: Labelled layouts: names of the parts around an article, by kind; the first of a
#: pair is the tag, and behind it stands a class (.), an id (#) or a role (@), in
#: English and some in German, French and Spanish. Stated plainly; the pages are made from them by a seeded draw.
PARTS = {
    "menu": "nav nav.menu nav#navigation div.nav div.navbar div.menu ul.menu ul#main-nav div#menu div.breadcrumb div.breadcrumbs nav.pagination div.pager div.toolbar div.topbar div.tabs div@navigation div@menu div.navigation div.menue",
    "header": "header header.site-header div.header div#header div.masthead div.site-title div.logo div.branding div.banner div#top div@banner div.kopf div.cabecera div.entete",
    "footer": "footer footer.site-footer div.footer div#footer div.copyright div.legal div.bottom div.credits div@contentinfo div.fuss div.impressum div.pie",
    "sidebar": "aside aside.sidebar div.sidebar div#sidebar div.related div.related-posts div.widget div.widget-area div.trending div.popular div.recommended div.more div.rail div.tags div.author-box div.secondary aside.related div.side div@complementary div.seitenleiste div.verwandt div.lateral div.relacionados div.barre-laterale",
    "notice": "div.notice div.cookie-notice div#cookie-banner div.cookies div.alert div.consent div.gdpr div.newsletter div.subscribe div.subscription div.paywall div.popup div.modal div.overlay p.disclaimer div.disclaimer div.message div.warning section.notice aside.notice div.announcement p.notice p.cookie dialog div.hinweis div.avis div.aviso div@dialog div@alert div@alertdialog section@status",
    "advert": "div.ad div.ads div.advert div.advertisement div#ad-top div.sponsored div.sponsor div.promo div.promotion aside.ad aside.advert section.ad p.ad ins.adsbygoogle div.banner-ad div.adbox div.commercial div.werbung div.anzeige div.publicite div.publicidad aside.anuncio",
    "form": "form form.search form#login div.form div.search div.search-box div.login form.contact form.comment-form div.signup div@search div@form div.suche div.recherche div.formular",
    "comments": "section.comments section#comments div.comments div#comments div.comment ol.comment-list ul.comments div.replies div#disqus_thread div.discussion section.reader-comments div.responses article.comment div.user-comments section.feedback div.reviews aside.comments div.kommentare section.commentaires div.comentarios",
    "share": "div.share div.social ul.social-links div.sharing div.follow",
}
CONTENT = ["<p>%</p>"] * 8 + "<p>% <h2>@</h2> <h3>@</h3> <h4>@</h4> <ul><li>%</li><li>%</li></ul> <ol><li>%<li>%</ol> <blockquote>%</blockquote> <blockquote><p>%</p></blockquote> <pre>%</pre> <table><tr><th>@</th><td>@</td></tr><tr><td>%</td><td>@</td></tr></table> <figure><img><figcaption>@</figcaption></figure> <div>%</div> <section><h2>@</h2><p>%</p></section> % <dl><dt>@</dt><dd>%</dd></dl> <p><a>@</a></p> <ul><li><a>@</a></li><li><a>@</a></li></ul> <p><a>@</a>_<a>@</a></p>".split()
WRAPS = "article article.post article.story main main#content div.content div#content div.post div.post-body div.entry div.entry-content div.article div.article-body div.story div.text div.body-text section.article section.content div.main div#main article.article div.page-content"
OUTER = "- - div.wrapper div#page div.container main div#main div.site div.row div.layout section"


def _open(name: str, gold: bool = False) -> tuple[str, str]:
    tag, mark, value = name.partition(next((m for m in ".@" if m in name), "#"))
    attr = f' {dict(zip(".@#", ("class", "role", "id"), strict=True))[mark]}="{value}"' if value else ""
    return f"<{tag}{attr}{' data-gold=1' if gold else ''}>", f"</{tag}>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages whose content elements carry data-gold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstnlmdc") for _ in range(rng.randint(2, 9)))
    text = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])
    filled = lambda form: re.sub("@", lambda _: text(1, rng.choice([3, 12, 40])), form.replace("_", " "))
    link = lambda: f"<a href=/{word()}>{text(1, 4)}</a>"

    def part(kind: str) -> str:
        start, end = _open(rng.choice(PARTS[kind].split()))
        tag = start[1:-1].split()[0]
        if kind in ("menu", "share"):
            items = "".join(f"<li>{link()}</li>" if tag != "ul" or rng.random() < 2 else link() for _ in range(rng.randint(2, 8)))
            body = items if tag == "ul" else rng.choice([f"<ul>{items}</ul>", " ".join(link() for _ in range(4))])
        elif kind in ("sidebar", "header", "footer"):
            body = rng.choice([f"<h3>{text(1, 4)}</h3>", f"<h2>{text(1, 3)}</h2>", "", f"<h1>{text(1, 3)}</h1>" if kind == "header" else ""])
            body += rng.choice([f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>", f"<p>{text(4, 40)}</p>", f"&copy; {text(2, 14)}", f"<p>{text(3, 9)} {link()}</p>"])
        elif kind == "form":
            body = f"<label>{text(1, 4)}</label><input type=text><p>{text(2, 12)}</p><span>{text(1, 3)}</span>"
        elif kind == "comments":
            one = lambda: rng.choice(["<div class=comment><p>%s</p></div>", "<li><b>%s</b><p>%s</p></li>", "<p>%s</p>", "<article class=comment><header>%s</header><p>%s</p></article>"])
            items = [one() for _ in range(rng.randint(1, 5))]
            body = rng.choice([f"<h3>{text(1, 3)}</h3>", "", f"<h2>{text(1, 2)}</h2>"]) + "".join(x.replace("%s", text(3, 60)) for x in items)
        else:
            body = rng.choice([text(3, 40), f"<p>{text(3, 40)}</p>", f"<p>{text(3, 20)}</p><p>{text(2, 20)} {link()}</p>", f"<b>{text(1, 5)}</b> {text(3, 20)}"])
        return start + body + end

    def content() -> str:
        inline = lambda: filled(rng.choice("@ @ @ @ <b>@ @_<em>@</em>_@ @_<a>@</a>_@ @<br>@ <strong>@</strong>_@ <span>@</span> <code>@</code> @_<a>@</a>".split()))
        body = []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            form = rng.choice(CONTENT)
            while "%" in form:
                form = form.replace("%", inline(), 1)
            body.append(filled(form))
        return "".join(body)

    for _ in range(n):
        start, end = _open(rng.choice(WRAPS.split()), gold=True)
        bare = rng.random() < 0.12
        title = rng.choice([f"<h1>{text(1, 12)}</h1>"] * 3 + ["", f"<header><h1>{text(1, 12)}</h1></header>"])
        inner = rng.choice(["%s"] * 4 + ["<div class=body>%s</div>", "<div>%s</div>", "<div class=article-body>%s</div>"]) % content()
        # parts that stand inside the article's element make it a mere holder of gold pieces
        if bare:
            article = title.replace("<h1", "<h1 data-gold=1").replace("<header", "<header data-gold=1") + "".join(f"<p data-gold=1>{text(1, 60)}</p>" for _ in range(rng.randint(1, 6)))
        elif rng.random() < 0.35:
            kinds = rng.choices(["advert", "comments", "notice", "share", "sidebar", "form"], k=rng.randint(1, 2))
            start = start.replace(" data-gold=1", "")
            pieces = [f"<div data-gold=1>{content()}</div>" if rng.random() < 0.3 else "".join(f"<p data-gold=1>{text(1, 60)}</p>" for _ in range(rng.randint(1, 4))) for _ in range(len(kinds) + 1)]
            title = title.replace("<h1", "<h1 data-gold=1").replace("<header", "<header data-gold=1")
            article = start + title + pieces[0] + "".join(part(k) + p for k, p in zip(kinds, pieces[1:], strict=True)) + end
        else:
            article = start + title + inner + end
        before = [part(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.45]
        after = [part(k) for k in ("share", "comments", "sidebar", "advert", "notice", "form", "menu", "footer") if rng.random() < 0.45]
        a, b = _open(rng.choice(OUTER.split())) if rng.random() < 0.6 else ("", "")
        a, b = ("", "") if a.startswith("<->") else (a, b)
        cut = rng.randint(0, len(before))
        yield f"<html><head><title>{text(2, 6)}</title></head><body>{''.join(before[:cut])}{a}{''.join(before[cut:])}{article}{''.join(after)}{b}</body></html>"


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(list(labelled_pages()))


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    Null and empty html, and pages without content, give an empty text. Repeated
    rows give equal texts; an empty table no rows; other columns are ignored.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column(2)]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            # ids don't leave Arrow, where a null leaves the others as they are
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extract": op1_html_extract}
