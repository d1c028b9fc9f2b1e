r"""Secret scan: patterns of known form, and a battery of randomness tests for the rest.

Everything is a Spark expression over the row of a document. Long runs of token
characters, without what the patterns cover, are candidates. Each is given the
narrowest encoding whose alphabet it fits, and tested against uniform randomness in
that alphabet three ways:

* chi-squared statistic of its symbol counts;
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* serial correlation of neighbouring symbols' ranks.

Fisher's method combines the three. A second p-value says how likely words, names
and paths would be to look as random as the candidate: the ratio of its likelihoods
under a chain of letters, digits and marks as they follow each other in such text
and under uniform randomness. By Markov's inequality the ratio itself is a p-value
under that chain; it falls exponentially with the length.

The p-value that is controlled is both together: the second one, divided by what the
battery leaves of randomness where it speaks against it (under TOLERATED), so that a
token must be unlike text and like randomness, and what the tests find counts by its
size. It isn't smaller than the second, so it is a p-value as well.

False discoveries are controlled over the corpus: candidates and base spans of their
length are counted by encoding, class of length and bin of this p-value, and the
Benjamini-Hochberg procedure in each encoding and class of length, over all of them,
gives the p-value up to which they are discoveries. Candidates whose randomness the
battery doesn't reject are reported; of base spans it is told.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetta.functions.arrays import once, running
from gazetta.llm.common import table, written

#: The forms of known secrets, by kind in order, and the group that
#: must have so many characters.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: Quick tests of a text; a run of a greedy class has 24 characters if the class can be repeated 24 times.
MAY = {"assign": ASSIGN, "access": ACCESS, "hex": r"[0-9a-f]{24}"}
SCAN = {"assign": ASSIGN, "access": ACCESS, "hex": r"[0-9a-f]{24,}+"}

#: Candidates for the battery: least length, false discovery rate, level at which
#: the battery rejects randomness; first lengths of the classes; bins of a decade of
#: the p-value, and decades that are told apart.
LENGTH, FDR, ALPHA = 20, 0.01, 0.001
#: From which p-value of randomness on the battery says nothing against it.
TOLERATED = 0.1
CLASSES = (20, 24, 32, 48, 96)
BINS, DECADES = 4, 60
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % LENGTH
#: Alphabets from narrow to wide.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: What follows a letter (a row each, then a digit, then a mark or the beginning) in
#: names, words and paths: -10 ln of the chance of each letter, a digit, a mark, as a
#: symbol of base62. Counted in runs of the Python standard library's sources (two
#: thirds) and of documents in English, German, French and Spanish; a tenth is spread
#: over all symbols.
FOLLOWS = """
ldUVgqepVvlPUIkdvOQJVknpkyaf
PqfnIvtwXSyDrsQjyZdqPywyYuYc
PwlsNrvGTySSnrHtvbmNauwypyaa
RhsaBrmgLwyYwfNvybWaZwlslyZS
SmYSaanmZxuOeLgfnIORkjkZlpaX
PrkkTTopGzvXrqFrxNcYTvrymvZY
RkpuCwdVRztYlVZrzVNZVonzypaT
Ihrw9ysaRzsftbQsxcaUmsizwtbc
ehVbSgctnxtUXCMgtcRNxhvmzibf
DzhwByzylylwyyLnzwbtPzyzvzaY
bqmk7pguPyxZwclkulRpivVyoyaN
SordEKwxNywQusRnysWaYvvyPxbZ
JaumAwxxRzvibqPNzuZldyyzszbY
RiXKMiNfYwmfqcPnshTJgjlyruba
keZVoekydwkcWDeYwIWUOkerxwac
HwmkJawnXzuQvuMVxNhPcptyazaX
xxwwxyyxxyzmystuumoy2yxzzzaa
OkghCpbhSxmhfTOpxUUSemlydvbZ
brWqDulQTuninnYarlTGZwpxgybW
SoloLrwCJztjrnXmxSaaWunwdkbU
cdgoIejobzvRWLdWsKSPtrtUzvXe
Eutx8uxwLzwvpsYvyuvvyyuyyyXb
LxthXuyBGyyjsaVvzSbtwxpwzzbV
WqIqRlxrSzyffxeRmgkDvmweexOS
cejoQstbWzyacUUHydKKupbxuvaN
WfdnBujmOqleeqajokgdEmxzskYb
bcdZghywvxyutqqrzxsvwxyVwy4P
RcUVPWhbWtmZaVUYlUPMehbuttYT
""".split()
#: Chance of a capital after a small letter, a capital, and anything else; of each mark.
CAPITAL, MARKS = (0.05, 0.6, 0.3), {"/": 0.35, "_": 0.3, "-": 0.3, "+": 0.025, "=": 0.025}
#: Symbols of a candidate.
SYMBOLS = ENCODINGS["base64"] + "="
MASK = "[SECRET]"


#: Characters of a stretch of a text that is cut from it at once, as cutting reads a text from its beginning.
STRETCH = 32_768
_SPAN = "struct<start:int,order:int,end:int,kind:string,token:string>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, order, end, kind, token) of a pattern's matches whose group has `least` characters or more."""
    gaps = F.split(text, pattern, -1)
    hits, groups = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))

    def told(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        spans = F.zip_with(steps, ends, lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), x["part"].alias("token")))
        return F.filter(spans, lambda s: F.length(s["token"]) >= least)

    # the last gap has no match behind it
    steps = once(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), groups.alias("part")), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))
    return once(steps, told)


def _outside(found: Column, base: Column) -> Column:
    """What base spans leave of the candidates, where it is long enough: stretches between the places where either begins or ends."""

    def event(at: Column, starts: int, ends: int, covers: int) -> Column:
        return F.struct(at.alias("at"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"), F.lit(covers).alias("covers"))

    def cut(found: Column, base: Column) -> Column:
        of = lambda spans, side, *what: F.transform(spans, lambda s: event(s[side], *what))
        events = F.array_sort(F.concat(of(found, "start", 1, 0, 0), of(found, "end", 0, 1, 0), of(base, "start", 0, 0, 1), of(base, "end", 0, 0, -1)))

        def pieces(events: Column) -> Column:
            count = lambda name: running(F.transform(events, lambda e: e[name]))
            places = F.arrays_zip(events.alias("e"), count("starts").alias("starts"), count("ends").alias("ends"), count("covers").alias("covers"))

            def between(x: Column, i: Column) -> Column:
                to = F.coalesce(F.get(events, i + 1)["at"], x["e"]["at"])
                free = (x["starts"] > x["ends"]) & (x["covers"] == 0) & (to - x["e"]["at"] >= LENGTH)
                return F.when(free, told(x["e"]["at"], to, F.get(found, x["starts"] - 1)))

            return F.filter(F.transform(places, between), lambda x: x.isNotNull())

        def told(start: Column, end: Column, whole: Column) -> Column:
            token = F.substring(whole["token"], start - whole["start"] + 1, end - start)
            return F.struct(start.alias("start"), F.lit(3).alias("order"), end.alias("end"), F.lit("random").alias("kind"), token.alias("token"))

        return once(events, pieces)

    return F.when(F.size(base) == 0, found).otherwise(once(found, lambda f: once(base, lambda b: cut(f, b))))


def _normal(z: Column) -> Column:
    """The normal distribution function, to three places."""
    z = F.greatest(F.lit(-7.0), F.least(F.lit(7.0), z))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565992 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return F.greatest(F.lit(1e-9), 2 * _normal(-F.abs(z)))


def _text_costs() -> list[float]:
    """-ln of the chance in running text of each of SYMBOLS after the beginning and after each of SYMBOLS."""
    kind = lambda c: ord(c.lower()) - 97 if c.isalpha() else 26 if c.isdigit() else 27

    def cost(a: str, b: str) -> float:
        hump = a.islower() and b.isupper()  # a word begins inside a name
        out = ENCODINGS["base62"].index(FOLLOWS[27 if hump else kind(a) if a else 27][kind(b)]) / 10
        if b.isalpha():
            upper = CAPITAL[0 if a.islower() else 1 if a.isupper() else 2]
            return out - math.log(upper if b.isupper() else 1 - upper)
        return out - math.log(0.1 if b.isdigit() else MARKS[b])

    return [cost(a, b) for a in ["", *SYMBOLS] for b in SYMBOLS]


def _encoding(token: Column) -> Column:
    """Name of the narrowest encoding that fits, padding left aside."""
    out = F.lit("base64")
    for name, values in reversed(list(ENCODINGS.items())[:-1]):
        out = F.when(token.rlike(f"^[{values}]+={{0,6}}$"), F.lit(name)).otherwise(out)
    return out


def _prepared(spans: Column) -> Column:
    """Spans (start, order, end, kind, token) with the token without its padding, the encoding and its alphabet."""

    def prepare(span: Column) -> Column:
        def full(encoding: Column) -> Column:
            alphabet = F.lit(None)
            for name, values in ENCODINGS.items():
                alphabet = F.when(encoding == name, F.lit(values)).otherwise(alphabet)
            token = F.regexp_replace(F.regexp_replace(span["token"], "=+$", ""), "[^A-Za-z0-9+/_=-]", "")
            return F.struct(*[span[c].alias(c) for c in ("start", "order", "end", "kind")], F.when(token == "", "-").otherwise(token).alias("token"), encoding.alias("encoding"), alphabet.alias("alphabet"))

        return once(_encoding(span["token"]), full)

    return F.transform(spans, prepare)


_KEPT = "s.start as start, s.order as order, s.end as end, s.kind as kind, s.encoding as encoding"


def _symbols(spans: str) -> str:
    """SQL, over an array of what _prepared gives: length n, alphabet size k, sum of squared counts, ranks r in the alphabet and t in SYMBOLS."""
    return f"""
    transform({spans}, s -> struct({_KEPT},
      double(length(s.alphabet)) as k, double(length(s.token)) as n,
      aggregate(array_distinct(split(s.token, '')), 0D, (a, c) -> a + power(length(s.token) - length(replace(s.token, c, '')), 2)) as squares,
      transform(split(s.token, ''), c -> double(instr(s.alphabet, c))) as r,
      transform(split(s.token, ''), c -> instr('{SYMBOLS}', c)) as t))"""


def _statistics(spans: str) -> str:
    costs = ",".join(f"{x:.4f}" for x in _text_costs())
    return f"""
    transform({spans}, s -> struct({_KEPT}, s.n as n, s.k as k,
      s.k / s.n * s.squares - s.n as chi,
      aggregate(s.r, 0D, (a, x) -> a + if(x > s.k / 2, 1, 0)) as high,
      aggregate(zip_with(slice(s.r, 1, size(s.r) - 1), slice(s.r, 2, size(s.r) - 1), (x, y) -> if((x > s.k / 2) = (y > s.k / 2), 0D, 1D)), 1D, (a, x) -> a + x) as runs,
      aggregate(s.r, 0D, (a, x) -> a + x) / s.n as mean, s.r as r,
      aggregate(zip_with(concat(array(0), slice(s.t, 1, size(s.t) - 1)), s.t, (x, y) -> try_element_at(cast(split('{costs}', ',') as array<double>), greatest(1, x * {len(SYMBOLS)} + y))), 0D, (a, x) -> a + x) as text))"""


def _scores(spans: str) -> str:
    return f"""
    transform({spans}, s -> struct({_KEPT}, s.n as n,
      (s.chi - (s.k - 1)) / sqrt(greatest(1e-9D, 2 * (s.k - 1) * (s.n - 1) / s.n)) as z_chi,
      2 * s.high * (s.n - s.high) / s.n + 1 as expected, s.runs as runs,
      aggregate(zip_with(slice(s.r, 1, size(s.r) - 1), slice(s.r, 2, size(s.r) - 1), (x, y) -> (x - s.mean) * (y - s.mean)), 0D, (a, x) -> a + x)
        / greatest(1e-9D, aggregate(s.r, 0D, (a, x) -> a + (x - s.mean) * (x - s.mean))) * sqrt(s.n) as z_serial,
      s.text - s.n * ln(s.k) - ln({len(ENCODINGS)}D) as ratio))"""


def _verdicts(scores: Column) -> Column:
    """Array of (start, order, end, kind, encoding, n, strength, random, evidence): -log10 of the p-value under running text, that of randomness, and -log10 of both together."""

    def verdict(s: Column) -> Column:
        spread = F.sqrt(F.greatest(F.lit(1e-9), (s["expected"] - 1) * (s["expected"] - 2) / F.greatest(F.lit(1.0), s["n"] - 1)))
        p = [F.greatest(F.lit(1e-9), _normal(-s["z_chi"])), _two_sided((s["runs"] - s["expected"]) / spread), _two_sided(s["z_serial"])]
        fisher = once(-(F.log(p[0]) + F.log(p[1]) + F.log(p[2])), lambda half: F.exp(-half) * (1 + half + half * half / 2))
        strength = F.greatest(F.lit(0.0), F.coalesce(s["ratio"], F.lit(0.0)) / math.log(10))
        told = F.struct(*[s[c].alias(c) for c in ("start", "order", "end", "kind", "encoding")], s["n"].cast("int").alias("n"), strength.alias("strength"), fisher.alias("random"))
        against = lambda t: F.least(F.lit(0.0), F.log10(F.greatest(F.lit(1e-30), t["random"]) / TOLERATED))
        return once(told, lambda t: t.withField("evidence", F.greatest(F.lit(0.0), t["strength"] + against(t))))

    return F.transform(scores, verdict)


def _tested(rows: DataFrame, column: str) -> DataFrame:
    """rows with the battery's verdicts in place of the spans in column."""
    rest = [c for c in rows.columns if c != column]
    rows = rows.select(*rest, _prepared(F.col(column)).alias(column))
    return rows.select(*rest, _verdicts(F.expr(_scores(_statistics(_symbols(column))))).alias(column))


def scanned(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The row of each document in `_doc` (only the named columns), and its spans with the battery's verdicts.

    base: spans of the known forms, by start and kind, in code points with the end
    exclusive; found: what they leave of the candidates. Both are empty for null and
    empty texts. Repeated rows get equal spans, an empty table gives no rows, and
    columns of any name may stand beside text.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in columns or docs.columns]).alias("_doc"), docs["text"].alias("_text"))
    base = [F.when(text.rlike(MAY[k]), _spans(text, k, i, SCAN[k], group, least)).otherwise(F.expr(_NO_SPANS)) for i, (k, (_, group, least)) in enumerate(KINDS.items())]
    found = F.when(text.rlike(CANDIDATE), _spans(text, "random", 3, CANDIDATE, 0, LENGTH)).otherwise(F.expr(_NO_SPANS))
    rows = rows.select("_doc", F.array_sort(F.concat(*base)).alias("base"), found.alias("found"))
    rows = rows.select("_doc", "base", _outside(F.col("found"), F.col("base")).alias("found"))
    return _tested(_tested(rows, "found"), "base").select("_doc", "base", "found")


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, first in enumerate(CLASSES[1:], 1):
        out = F.when(n >= first, i).otherwise(out)
    return out


def _bin(strength: Column) -> Column:
    return F.floor(F.least(strength, F.lit(float(DECADES))) * BINS).cast("int")


def thresholds(found: DataFrame) -> dict[tuple[str, int], int]:
    """Least bin of the discoveries of each encoding and class of length that has any, from all candidates in found (found: array, base spans too).

    The candidates become counts by encoding, class and bin before they are
    exchanged: at most len(ENCODINGS) * len(CLASSES) * (DECADES * BINS + 1) rows,
    and what the driver gets is a row for each encoding and class at most.
    """
    each = found.select(F.explode("found").alias("s")).select("s.encoding", _class(F.col("s.n")).alias("class"), _bin(F.col("s.evidence")).alias("bin"))
    counts = each.groupBy("encoding", "class", "bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("encoding", "class")
    counts = counts.select("encoding", "class", "bin", F.sum("n").over(own.orderBy(F.desc("bin"))).alias("up_to"), F.sum("n").over(own).alias("all"))
    # the p-value of a bin is its largest
    bars = counts.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= FDR * F.col("up_to") / F.col("all")).groupBy("encoding", "class").agg(F.min("bin").alias("bar"))
    return {(r["encoding"], r["class"]): r["bar"] for r in bars.collect()}


def _holds(bars: dict[tuple[str, int], int]):
    """Whether a span is a discovery whose randomness isn't rejected."""
    names = [f"{encoding}:{k}" for encoding, k in bars]
    flat = [x for name, bar in zip(names, bars.values(), strict=True) for x in (F.lit(name), F.lit(bar))]

    def holds(s: Column) -> Column:
        if not bars:
            return F.lit(False)
        bar = F.element_at(F.create_map(*flat), F.concat_ws(":", s["encoding"], _class(s["n"])))
        return F.coalesce(_bin(s["evidence"]) >= bar, F.lit(False)) & (s["random"] >= ALPHA)

    return holds


def discovered(rows: DataFrame) -> DataFrame:
    """rows of scanned with extra, the candidates that are reported, and n_base_random, base spans that the same bars find random. rows is read twice, so it should be written."""
    long = lambda s: s["n"] >= LENGTH
    holds = _holds(thresholds(rows.select(F.concat("found", F.filter("base", long)).alias("found"))))
    return rows.select("_doc", "base", F.filter("found", holds).alias("extra"), F.size(F.filter("base", lambda s: long(s) & holds(s))).cast("long").alias("n_base_random"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_random, n_base_random and battery of each row.

    battery has start:encoding:strength:random of each span in spans, the last two
    rounded: -log10 of its p-value under running text, and the p-value of randomness.
    """
    rows = discovered(written(scanned(docs.select("doc_id", "text"), ["doc_id"]), "spans"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in KINDS]
    rows = rows.withColumn("all", F.array_sort(F.concat("base", "extra")))
    battery = F.transform("all", lambda s: F.concat_ws(":", s["start"], s["encoding"], F.format_string("%.1f:%.3f", s["strength"], s["random"])))
    return rows.select(
        F.col("_doc.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("all")).alias("spans"),
        F.size("extra").cast("long").alias("n_random"), "n_base_random", F.array_join(battery, ",").alias("battery"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the mask in place of each span; spans that begin inside another go with it."""

    def joined(gaps: Column) -> Column:
        def stretch(p: Column) -> Column:
            here = F.filter(gaps, lambda g: (g["a"] < p + STRETCH) & ((g["b"] > p) | (g["a"] >= p)))
            cut = lambda part: F.transform(here, lambda g: F.concat(F.when((g["a"] >= p) & (g["a"] > 0), mask).otherwise(""), once(F.greatest(g["a"], p), lambda a: F.substring(part, a - p + 1, F.least(g["b"], p + STRETCH) - a))))
            return F.array_join(once(F.substring(text, p + 1, F.lit(STRETCH)), cut), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text), F.lit(STRETCH)), stretch), "")

    def gaps(furthest: Column) -> Column:
        before = lambda i: F.coalesce(F.get(furthest, i - 1), F.lit(0))
        between = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.struct(before(i).alias("a"), s["start"].alias("b"))))
        last = F.struct(F.element_at(furthest, -1).alias("a"), F.length(text).alias("b"))
        return F.concat(F.filter(between, lambda g: g.isNotNull()), F.array(last))

    # a span at the very beginning leaves an empty gap before it, which needs no mask of its own
    return once(once(running(F.transform(spans, lambda s: s["end"]), F.greatest), gaps), joined)


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every span of the text replaced by the mask; n_chars follows, null texts stay null."""
    rows = discovered(written(scanned(docs), "spans"))
    text = F.col("_doc.text")
    spans = F.array_sort(F.concat("base", "extra"))
    rows = rows.select("_doc", F.when(F.size(spans) > 0, once(spans, lambda s: _masked(text, s, mask))).otherwise(text).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_text") == text, F.col("_doc.n_chars")).otherwise(F.length("_text").cast(dict(docs.dtypes)["n_chars"]))} if "n_chars" in docs.columns else {"text": F.col("_text")}
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return redacted(docs)


QUERIES = {"op7_secret_scan": op7_secret_scan}
