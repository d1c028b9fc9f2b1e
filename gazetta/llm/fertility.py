"""Quality rules from tokeniser fertility, beside word rules that need no tokeniser.

Public vocabularies say how many characters a token covers, which share of tokens
are bytes because the vocabulary has no piece for them, and how the tokens of a text
are spread: Shannon's entropy, and the collision entropy, -ln of the chance that two
tokens are alike, whose estimate from pairs of tokens doesn't depend on the length.

Texts outside the bands of their language and script are rejected. A script has wide
fixed bands. Fences around the quartiles of all texts of a language and script that
pass the word rules make them narrower; the fixed bands count as a few more texts, so
that they decide alone where there are none and count little where there are many.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetta.llm.common import lean, sized, table, written

#: Vocabulary files: pieces with byte fallback, and byte-level ranks.
PIECES, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of the texts that are encoded together.
CHARS = 1_000_000

#: Code points of the scripts; what is in none of them and beyond ASCII is `other`.
SCRIPTS = {
    "latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)),
    "greek": ((0x370, 0x400), (0x1F00, 0x2000)),
    "cyrillic": ((0x400, 0x530),),
    "hebrew": ((0x590, 0x600),),
    "arabic": ((0x600, 0x780), (0x8A0, 0x900), (0xFB50, 0xFE00), (0xFE70, 0xFF00)),
    "indic": ((0x900, 0xE00),),
    "thai": ((0xE00, 0xE80),),
    "hangul": ((0x1100, 0x1200), (0xAC00, 0xD7B0)),
    "cjk": ((0x3040, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)),
}
#: Fixed bands by script: least and most characters per piece and per byte-level
#: token, highest share of byte tokens, least collision entropy.
BANDS = {
    "latin": (1.6, 8.0, 1.3, 8.0, 0.20, 2.5),
    "greek": (0.8, 5.0, 0.5, 4.0, 0.30, 2.0),
    "cyrillic": (1.2, 6.0, 0.5, 4.0, 0.15, 2.5),
    "hebrew": (0.8, 5.0, 0.5, 4.0, 0.30, 2.0),
    "arabic": (0.8, 5.0, 0.5, 4.0, 0.30, 2.0),
    "indic": (0.45, 4.0, 0.3, 3.0, 0.70, 1.5),
    "thai": (0.45, 4.0, 0.3, 3.0, 0.70, 1.5),
    "hangul": (0.40, 3.0, 0.3, 3.0, 0.80, 1.5),
    "cjk": (0.40, 3.0, 0.3, 3.0, 0.75, 1.5),
    "other": (0.35, 5.0, 0.3, 4.0, 0.85, 1.5),
}
#: Measures with the sides on which their bands are closed.
MEASURES = {"chars_per_piece": (True, True), "chars_per_token": (True, True), "byte_share": (False, True), "collision": (True, False)}
#: Fences: quartiles and so many times their distance and a margin for each measure;
#: texts as which the fixed bands count; steps of a unit in which measures are counted.
FENCE, MARGINS, PRIOR, STEPS = 4.0, {"chars_per_piece": 0.2, "chars_per_token": 0.2, "byte_share": 0.06, "collision": 0.3}, 50, 100
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 | 1 for k in range(64)], np.uint64)


class Vocabularies:
    def __init__(self, pieces: str, ranks: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.bytes = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def measured(self, texts: list[str]) -> list[tuple[int, float, float, float, float, float]]:
        """Pieces, characters per piece and per byte-level token, share of byte pieces, entropy and collision entropy of each text."""
        every = self.pieces.encode(texts, num_threads=1)
        return [(len(own), *self._measures(len(t), np.array(own, np.int64), len(self.ranks.encode_ordinary(t)))) for t, own in zip(texts, every, strict=True)]

    def _measures(self, chars: int, ids: np.ndarray, tokens: int) -> tuple[float, float, float, float, float]:
        n = len(ids)
        if not n:
            return 0.0, 0.0, 0.0, 0.0, 0.0
        own = np.sort(ids)
        count = np.diff(np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]))
        p = count / n
        # of pairs of tokens, one at least counts as alike
        alike = max(1.0, float((count * (count - 1)).sum()))
        return chars / n, chars / max(1, tokens), float(self.bytes[ids].mean()), float(-(p * np.log(p)).sum()), math.log(max(1, n * (n - 1)) / alike) if n > 1 else 0.0


@lru_cache(maxsize=1)
def vocabularies(pieces: str = PIECES, ranks: str = RANKS) -> Vocabularies:
    return Vocabularies(pieces, ranks)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words which the list has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    # equal windows have equal sums of hashes; where no two sums are equal, there are none
    key = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    sums = np.sort(sum(key[k : n - width + 1 + k] * _ODD[k % len(_ODD)] for k in range(width)))
    if (sums[1:] != sums[:-1]).all():
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    key = np.fromiter(map(number.__getitem__, words), np.int64, n)
    span = 1
    while span < width:  # numbers of windows of twice the words, from pairs of numbers
        step = min(span, width - span)
        pair = key[:-step] * (key.max() + 1) + key[step:]
        _, key, count = np.unique(pair, return_inverse=True, return_counts=True)
        span += step
    inside = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(count[key] > 1)
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + width, -1)
    return int((np.cumsum(inside) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text with these words."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def script(text: str) -> str:
    """Script of most characters that are of one or beyond ASCII; latin of none, and of ties the first."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    own = points[points >= 0xC0]
    parts = {name: sum(int(((own >= a) & (own < b)).sum()) for a, b in ranges if b > 0xC0) for name, ranges in SCRIPTS.items()}
    # punctuation and signs that scripts share are of none
    shared = int(((own >= 0x2000) & (own < 0x2100)).sum() + ((own >= 0x3000) & (own < 0x3040)).sum())
    parts["other"] = len(own) - shared - sum(parts.values())
    parts["latin"] += int((((points | 32) - 0x61) < 26).sum())
    return max(parts, key=parts.get)


_OUT = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_pieces long, chars_per_piece double, chars_per_token double, byte_share double, entropy double, collision double"


_BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _ruled_text(text: str) -> tuple:
    """n_words, what base_counts tells, and base_failed of a text."""
    words = text.encode().split()
    base = base_counts(text, words)
    return len(words), *base, len(words) < 20 or 100 * base[3] > 30 * len(words)


def base_ruled(docs: DataFrame) -> DataFrame:
    """What the base rules say of each row of docs (doc_id, text): columns of measured() that need no vocabulary, without it."""
    columns = [x.split() for x in _BASE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_ruled_text(t.as_py() or "") for t in batch.column(1)]
            arrays = [pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[name for name, _ in columns])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(run), _BASE)


def _slices(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= CHARS or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, total = i + 1, 0


def measured(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """Counts and measures of each row of docs (doc_id, text and, if there is one, lang), without a verdict."""
    lang = "coalesce(cast(lang as string), '') as lang" if "lang" in docs.columns else "'' as lang"
    columns = [x.split() for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(pieces, ranks)
        for batch in batches:
            for part in _slices([x.as_buffer().size if x.is_valid else 0 for x in batch.column(1)]):
                some = batch.slice(part.start, part.stop - part.start)
                texts = [t or "" for t in some.column(1).to_pylist()]
                rows = [(script(t), *_ruled_text(t), *told) for t, told in zip(texts, own.measured(texts), strict=True)]
                arrays = [pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(columns[2:])]
                # ids don't leave Arrow, where a null leaves the others as they are
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *arrays], names=[name for name, _ in columns])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", lang).mapInArrow(lean(run), _OUT)


def fitted_bands(rows: DataFrame) -> DataFrame:
    """lang, script, n (texts that pass the word rules), and least and most of each measure (NULL where a side is open), from all rows of `measured`.

    Measures are counted in steps, so that what is exchanged is a count for each step,
    and the quartiles don't depend on how rows are dealt out.
    """
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * STEPS).cast("long").alias("step")) for m in MEASURES])
    counts = rows.where("NOT base_failed").select("lang", "script", F.explode(each).alias("x")).groupBy("lang", "script", "x.measure", "x.step").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang", "script", "measure")
    counts = counts.select("lang", "script", "measure", "step", F.sum("n").over(own.orderBy("step")).alias("up_to"), F.sum("n").over(own).alias("n"))
    at = lambda q: F.min(F.when(F.col("up_to") >= q * F.col("n"), F.col("step"))) / STEPS
    quartiles = counts.groupBy("lang", "script", "measure").agg(F.max("n").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    wide = quartiles.groupBy("lang", "script").agg(F.max("n").alias("n"), *[of(m, q).alias(f"{m}_{q}") for m in MEASURES for q in ("q1", "q3")])

    def fence(m: str, side: str) -> Column:
        out = FENCE * (F.col(f"{m}_q3") - F.col(f"{m}_q1")) + MARGINS[m]
        return F.col(f"{m}_q1") - out if side == "least" else F.col(f"{m}_q3") + out

    share = F.col("n") / (F.col("n") + PRIOR)

    def bound(m: str, side: str) -> Column:
        fixed = fixed_band(m, side)
        return (F.greatest if side == "least" else F.least)(fixed, share * fence(m, side) + (1 - share) * fixed)

    bounds = [bound(m, side).alias(f"{m}_{side}") for m, sides in MEASURES.items() for side, closed in zip(("least", "most"), sides, strict=True) if closed]
    return wide.select("lang", "script", "n", *bounds)


def fixed_band(measure: str, side: str) -> Column:
    """A side of the fixed band of a measure, by the column script."""
    names = [(m, s) for m, sides in MEASURES.items() for s, closed in zip(("least", "most"), sides, strict=True) if closed]
    at = names.index((measure, side))
    flat = [F.lit(x) for name, band in BANDS.items() for x in (name, band[at])]
    return F.element_at(F.create_map(*flat), F.col("script"))


def ruled(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """Counts, measures and verdict of each row of docs (doc_id, text and, if there is one, lang).

    A null text has no words; it and other texts of fewer than 20 words fail the
    base rules. A null lang is the language of no name; each language has bands in
    each script. Repeated rows get equal results and count each in the bands, an
    empty table gives no rows, other columns are ignored.
    """
    rows = written(measured(docs, pieces, ranks), "measures")
    bands = written(fitted_bands(rows), "bands").drop("n")  # a row for each language and script
    rows = rows.join(sized(bands), ["lang", "script"], "left")
    inside = F.lit(True)
    for m, sides in MEASURES.items():
        for side, closed in zip(("least", "most"), sides, strict=True):
            if closed:
                bound = F.coalesce(F.col(f"{m}_{side}"), fixed_band(m, side))
                inside = inside & (F.col(m) >= bound if side == "least" else F.col(m) <= bound)
    kept = (~F.col("base_failed") & inside).alias("kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "script", "n_pieces", "chars_per_piece", "chars_per_token", "byte_share", "entropy", "collision")


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fertility": op3_fertility}
