"""Spelling variants of a vocabulary, by a bit-sliced index of letters by position.

A block of words of one length has, for each position and letter, a bitset over
the block: the words with that letter there. A word that asks goes through its
letters once and keeps four sets for the whole block at a time: the words that
agree so far, and those with one letter replaced, one left out or one put in so
far, the last two against positions shifted by one. A step is a few ANDs and ORs of
the bitsets, for 64 words at once and for many askers together; no pair of words is
ever looked at by itself, and no pair leaves a block: what does is the number of
near words and the best of them, which is the lowest bit, as blocks are in order of
preference.

Which blocks a word has to ask follows from the pigeonhole principle: with one error
at most, one half of the indexed word stands in the other unchanged, as its start or
as its end. So a word is indexed under its first and under its second half, and asks
with its own start and end for the lengths one less, equal and one more. A near word
found by its end counts only if it doesn't share the start, so each is found once.
Halves that many words share are dealt out: their words over several blocks, the
askers over several tasks, and each asker meets each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm.common import sized, stored, table, trimmed, written
from gazetta.session import removed

#: A run of letters; the capitals A-Z are lower-cased before.
RUN = r"[A-Za-zÀ-ÿ]+"
#: A run loses a letter if this divides its checksum.
DROPPED = 97
#: Least code points and occurrences of a word; a form occurs so many times as often as the word, at least.
LEAST, OFTEN, TIMES = 5, 3, 2
#: Words of a block in mean, at most (in mean again), and letters of a block at most; askers of a task for each indexed word of their halves.
BLOCK, MOST, LETTERS, ASKING = 1024, 4096, 1 << 20, 16384
#: Cells of the matrices of one step (askers times 64-bit parts of a block).
CELLS = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "word binary, n_near long, form binary, form_n long"


def runs(text: Column) -> Column:
    """The lower-cased runs of a text of LEAST code points or more, as an array."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    return F.filter(found, lambda x: F.length(x) >= LEAST)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of the words of docs (doc_id, text): counted on the map side first, so that a word in every text is no hot key."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs(F.col("text"))).alias("run"))
    mark = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    own = own.select("run", mark.alias("mark"))
    at = F.pmod("mark", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("mark") % DROPPED == 0, less).otherwise(F.col("run"))
    return own.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


class Block:
    """Bitsets over words of one length, given as Latin-1 bytes, the most wanted first."""

    def __init__(self, words: np.ndarray):
        """words: a matrix of letters, a row for each word."""
        self.count, self.length = words.shape
        self.parts = -(-self.count // 64)
        code = (np.arange(self.length) << 8 | words.astype(np.int64)).ravel()
        self.codes, row = np.unique(code, return_inverse=True)
        self.bits = np.zeros((len(self.codes) + 1, self.parts), np.uint64)  # the last row is empty
        word = np.repeat(np.arange(self.count), self.length)
        np.bitwise_or.at(self.bits, (row.ravel(), word // 64), np.uint64(1) << (word % 64).astype(np.uint64))
        self.all = _ones(self.count)

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at a position; none before the first and behind the last."""
        want = position << 8 | letters.astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        inside = (0 <= position < self.length) & (self.codes[at] == want)
        return self.bits[np.where(inside, at, len(self.codes))]

    def near(self, asking: np.ndarray, by_start: bool) -> np.ndarray:
        """Bitsets of the words with exactly one error to each row of a matrix of letters, as found by the start or by the end.

        by_start: those whose first half the asker starts with; else those whose first half it doesn't.
        """
        n, m = asking.shape
        shift = m - self.length  # 1: the asker has a letter more
        same = np.tile(self.all, (n, 1))
        other = np.zeros_like(same)
        half, started = self.length // 2, None
        for i in range(m):
            if i == half:
                started = same
            letter = asking[:, i]
            here = self.having(i, letter)
            if shift == 0:
                other = other & here | same & ~here
            elif shift == 1:
                other = other & self.having(i - 1, letter) | same
            else:
                other = (other | same) & self.having(i + 1, letter)
            same = same & here
        if shift < 0:
            other = other | same
        started = same if started is None else started
        return other & (started if by_start else ~started)


def _ones(count: int) -> np.ndarray:
    """A bitset with the first count bits."""
    out = np.zeros(-(-count // 64), np.uint64)
    out[: count // 64] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if count % 64:
        out[-1] = np.uint64((1 << count % 64) - 1)
    return out


def _lowest(bits: np.ndarray) -> np.ndarray:
    """The lowest bit of each row, all of which have one."""
    part = (bits != 0).argmax(1)
    own = bits[np.arange(len(bits)), part]
    return part * 64 + np.bitwise_count((own & (~own + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words together, and where each begins, with the end."""
    words = words.cast(pa.large_binary())
    edge = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), edge


def _asked(rows: pa.Table) -> pa.Table:
    """What the askers of one cell find in its block."""
    by_start = rows["by_start"][0].as_py()
    word, n, asks = (rows[c].combine_chunks() for c in ("word", "n", "asks"))
    flat, edge = _letters(word)
    n, asks = n.to_numpy(zero_copy_only=False), asks.to_numpy(zero_copy_only=False).astype(bool)
    size = np.diff(edge)
    own = np.flatnonzero(~asks)
    matrix = lambda rows, m: flat[edge[rows][:, None] + np.arange(m)]
    out = {"word": [], "n_near": [], "form": [], "form_n": []}
    if len(own):
        length = int(size[own[0]])
        text = np.ascontiguousarray(matrix(own, length))
        order = np.argsort(text.view(f"S{length}").ravel(), kind="stable")
        order = order[np.argsort(-n[own][order], kind="stable")]  # larger n first, then in the order of code points
        own, block = own[order], Block(text[order])
        for m in (length - 1, length, length + 1):
            who = np.flatnonzero(asks & (size == m))
            step = max(1, min(CELLS // block.parts, LETTERS // max(1, m)))
            for at in range(0, len(who), step):
                some = who[at : at + step]
                bits = block.near(matrix(some, m), by_start)
                count = np.bitwise_count(bits).sum(1, dtype=np.int64)
                hit = np.flatnonzero(count)
                if len(hit):
                    best = own[_lowest(bits[hit])]
                    out["word"].append(word.take(pa.array(some[hit])))
                    out["n_near"].append(count[hit])
                    out["form"].append(word.take(pa.array(best)))
                    out["form_n"].append(n[best])
    bytes_of = lambda x: pa.chunked_array(x, pa.binary()).combine_chunks() if x else pa.array([], pa.binary())
    longs = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
    trimmed()
    return pa.table({"word": bytes_of(out["word"]), "n_near": longs(out["n_near"]), "form": bytes_of(out["form"]), "form_n": longs(out["form_n"])})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_word and best_n of each of words (word, n; distinct, of letters up to U+00FF) with a near word; written.

    Of near words the one with the largest n is best, of several the smallest in
    the order of code points.
    """
    own = words.select(F.encode("word", "ISO-8859-1").alias("word"), "n").withColumn("size", F.length("word"))
    lengths = written(own.groupBy("size").agg(F.count("*").alias("count")), "lengths")
    buckets = F.ceil(F.col("count") / F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(LETTERS) / F.col("length")))))
    lengths = sized(lengths.select(F.col("size").alias("length"), buckets.cast("long").alias("buckets")))
    start = lambda n: F.substring("word", F.lit(1), n)
    end = lambda n: F.substring("word", F.col("size") - n + 1, n)

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        """Rows with a length, under the starts and under the ends of words of that length."""
        half = F.floor(F.col("length") / 2).cast("int")
        seeds = F.array(F.struct(F.lit(True).alias("by_start"), start(half).alias("seed")), F.struct(F.lit(False).alias("by_start"), end(F.col("length") - half).alias("seed")))
        rows = rows.join(lengths, "length").select("length", "buckets", "word", "n", F.explode(seeds).alias("s"))
        bucket = F.pmod(F.xxhash64("s.seed"), F.col("buckets"))
        return rows.select("length", F.col("s.by_start").alias("by_start"), bucket.alias("bucket"), "word", "n", F.lit(asks).alias("asks"))

    key = ["length", "by_start", "bucket"]
    index = dealt(own.withColumn("length", F.col("size")), False)
    # three lengths of each asker; those of which there is no word fall away in the join
    asking = dealt(own.select("*", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("length")), True)
    counts = index.groupBy(*key).agg(F.count("*").alias("count"))
    most = F.least(F.lit(MOST), F.greatest(F.lit(1), F.floor(F.lit(LETTERS) / F.col("length"))))
    large = counts.where(F.col("count") > most).select(*key, F.ceil(F.col("count") / most).cast("long").alias("blocks"), F.ceil(F.col("count") / ASKING).cast("long").alias("shares"))
    large = sized(written(large, "large"))
    one = F.lit(1).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with the block and the share of the askers that they meet in."""
        rows = rows.join(large, key, "left").withColumns({"blocks": F.coalesce("blocks", one), "shares": F.coalesce("shares", one)})
        drawn = F.xxhash64("word")
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        block = F.when(F.col("asks"), every("blocks")).otherwise(F.array(F.pmod(drawn, F.col("blocks"))))
        share = F.when(F.col("asks"), F.array(F.pmod(drawn, F.col("shares")))).otherwise(every("shares"))
        rows = rows.select(*key, "word", "n", "asks", F.explode(block).alias("block"), share.alias("share"))
        return rows.select(*key, "word", "n", "asks", "block", F.explode("share").alias("share"))

    cells = placed(index.unionByName(asking)).groupBy(*key, "block", "share").applyInArrow(_asked, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    found = cells.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return written(found.select(text(F.col("word")).alias("word"), "n_near", text(F.col("best.form")).alias("best_word"), (-F.col("best.less")).alias("best_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form), a written table: where following forms ends. Each round doubles the steps taken; a form occurs at least twice as often as its word, so there are few."""
    spark = forms.sparkSession
    at, path = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new, new_path = stored(at.join(further.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        removed(spark, path)
        at, path = new.drop("moved"), new_path
        if not new.where("moved").limit(1).count():
            return at


def spelling(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of docs (doc_id, text).

    A null text has no words; a null doc_id is an empty text in the checksums.
    Repeated rows are texts of their own. Words of any length are indexed; a step is
    taken for each letter. Of near words with equal n the smallest in the order of
    code points is the form. An empty table, or one without words, gives no rows.
    Other columns are ignored.
    """
    words = written(vocabulary(docs), "words")
    near = near_words(words)
    both = words.join(near.hint("merge"), "word", "left")
    good = F.col("best_n") >= TIMES * F.col("n")
    rows = written(both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best_word")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    last = roots(rows.where("form IS NOT NULL"))
    out = rows.join(last.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
