"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by their exact length, source by source. A source's target
is first met by whole copies of the source; what then remains is filled by the
same share of every length, and the rest, a few times the longest document, by a
bounded knapsack over the lengths that are left. The plan is a number of documents
for each length; which documents these are is decided by a seeded hash, bucket by
bucket, so that no length is ever sorted in one task.

Sources are weighted and their targets found by aggregates over a table of sources,
of which the driver sees sums only, so that their number has no bound.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazetta.llm.common import WORD, only_ids, table, written

#: Weights of the sources in order, repeating; share of all words to take; most
#: copies of a document.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
SEED = 20_240_601
#: The knapsack's budget is left at so many times the longest document.
ROOM = 8
#: Hash buckets in which the documents of a length are counted, and buckets that are summed up first.
BUCKETS, TOGETHER = 4096, 64


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> dict[str | None, float]:
    """Target of each source; sizes are in the order in which weights are dealt.

    A source over copies times its size is held there, and its excess goes to the
    others by weight, until none is above.
    """
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    cap = {s: float(copies * n) for s, n in sizes}
    left, free, out = share * sum(n for _, n in sizes), set(weight), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: cap[s] for s in over}
        left = max(0.0, left - sum(cap[s] for s in over))
        free -= over
    return out


def knapsack(budget: int, stock: list[tuple[int, int]]) -> dict[int, int]:
    """Numbers of items by length whose sum is as near to budget from below as any.

    stock: length and number of items, lengths distinct. The reachable sums are
    the bits of an integer; a length's items are bundled by powers of two.
    """
    bundles = []
    for size, n in stock:
        n, k = min(n, budget // size), 1
        while n > 0:
            bundles.append((size, min(k, n)))
            n, k = n - k, 2 * k
    mask, sums, marks, done = (1 << budget + 1) - 1, 1, [], 0
    for done, (size, k) in enumerate(bundles, 1):
        if done % MARK == 1:
            marks.append(sums)  # the others are made again, block by block, on the way back
        sums = (sums | sums << size * k) & mask
        if sums >> budget:
            break
    at, out = sums.bit_length() - 1, {}
    for first in reversed(range(0, done, MARK)):
        block, before = bundles[first : min(first + MARK, done)], [marks[first // MARK]]
        for size, k in block[:-1]:
            before.append((before[-1] | before[-1] << size * k) & mask)
        for (size, k), sums in zip(reversed(block), reversed(before), strict=True):
            if not sums >> at & 1:
                at -= size * k
                out[size] = out.get(size, 0) + k
    return out


#: Bundles between the sums that the knapsack keeps.
MARK = 64


def fit(budget: int, stock: dict[int, int]) -> dict[int, int]:
    """Numbers of documents by length for a budget of words; stock has positive lengths."""
    total = sum(size * n for size, n in stock.items())
    if budget >= total:
        return dict(stock)
    room = ROOM * max(stock)
    out = {size: n * max(0, budget - room) // total for size, n in stock.items()}
    left = budget - sum(size * n for size, n in out.items())
    for size in sorted(stock, reverse=True):
        if left > room:
            k = min(stock[size] - out[size], -(-(left - room) // size))  # short ones stay for the knapsack
            out[size] += k
            left -= k * size
    # long lengths first, so that short ones settle what is left
    free = [(size, stock[size] - out[size]) for size in sorted(stock, reverse=True) if size <= left and stock[size] > out[size]]
    for size, k in knapsack(left, free).items():
        out[size] += k
    return out


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source, a row for each length: whole copies of all, and how many get one more."""
    target, source_size = frame["target"].iloc[0], int(frame["source_size"].iloc[0])
    stock = {int(s): int(n) for s, n in zip(frame["size"], frame["n"], strict=True) if s > 0}
    whole = min(COPIES, int(target // source_size)) if source_size else 0
    budget = round(target) - whole * source_size
    more = fit(budget, stock) if whole < COPIES and budget > 0 else {}
    return frame[["source", "size", "source_size", "target"]].assign(whole=whole, more=frame["size"].map(lambda s: more.get(int(s), 0)).astype("int64"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row of docs (doc_id, text, source).

    Null texts have size 0 and null sources are a source of their own, the last.
    Rows of size 0 are never taken. Repeated rows are separate documents that are
    taken or left by the same rule; which of several rows with equal doc_id and
    size gets a last copy follows the hash of their text. An empty table gives no
    rows. Other columns are ignored.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), key.alias("key"))
    sized = written(sized.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(BUCKETS)).cast("int")), "sizes")
    counts = written(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    sources = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lengths = lengths.join(sources.select(F.col("source").alias("s"), "source_size", "target").hint("merge"), F.col("source").eqNullSafe(F.col("s")))
    plan = written(lengths.select("source", "size", "n", "source_size", "target").groupBy("source").applyInPandas(_plan, "source string, size long, source_size long, target double, whole int, more long"), "plan")
    # whole buckets up to the number wanted; the one across it is ranked document by document
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = F.floor(F.col("bucket") / TOGETHER).cast("int")
    coarse = counts.groupBy("source", "size", many.alias("b")).agg(F.sum("n").alias("n")).select("source", "size", "b", before("source", "size").alias("at"))
    fine = counts.select("source", "size", "bucket", "n", many.alias("m"), F.col("bucket").alias("b")).select("source", "size", "bucket", "n", "m", before("source", "size", "m").alias("own"))
    coarse = coarse.select(F.col("source").alias("s"), F.col("size").alias("l"), F.col("b"), "at")
    counted = fine.join(coarse.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")) & (F.col("m") == F.col("b"))).drop("s", "l", "b", "m")
    cut = counted.join(plan.select(F.col("source").alias("s"), F.col("size").alias("l"), "source_size", "target", "whole", "more").hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")))
    cut = cut.withColumn("room", F.col("more") - F.col("at") - F.col("own"))
    cut = cut.select(F.col("source").alias("s"), F.col("size").alias("l"), F.col("bucket").alias("b"), "source_size", "target", "whole", F.greatest(F.lit(0), F.least("room", "n")).alias("room"), (F.col("room") >= F.col("n")).alias("all"))
    dealt = sized.join(cut.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")) & (F.col("bucket") == F.col("b"))).drop("s", "l", "b")
    dealt = written(dealt, "dealt")
    sure = dealt.where("all OR room = 0").withColumn("one", F.col("all").cast("int"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("key", "doc_id"))
    edge = dealt.where("NOT all AND room > 0").withColumn("one", (rank <= F.col("room")).cast("int"))
    out = sure.unionByName(edge).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("one")).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", F.col("copies").cast("int").alias("copies"), "key")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """source, source_size, target of each row of sizes (source, source_size): what `targets` says, for any number of sources.

    Weights are dealt in the order of the sources, whose places are counted from
    the places in the sorted parts. A source is held at copies times its size if
    its size for a unit of weight is under the words for one; that only grows
    while sources are held, so a pass of sums for each step settles which are.
    """
    spark = sizes.sparkSession
    own = sizes.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k"))
    own = written(own, "sources")
    starts, at = [], 0
    for part, n in sorted((r["part"], r["count"]) for r in own.groupBy("part").count().collect()):  # a row for each part
        starts.append((part, at))
        at += n
    own = own.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("start") + F.col("k"), F.lit(len(weights))) + 1).cast("int"))
    own = own.select("source", "source_size", weight.alias("weight"), (F.lit(copies) * F.col("source_size")).alias("cap"))
    whole, total = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, held = share * whole, F.lit(False)
    while total:
        held = F.lit(left) * F.col("weight") / F.lit(total) > F.col("cap")
        caps, free = own.agg(F.coalesce(F.sum(F.when(held, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))).first()
        if free == total:
            break
        left, total = max(0.0, share * whole - caps), free
    target = F.when(held, F.col("cap").cast("double")).otherwise(F.lit(left) * F.col("weight") / F.lit(total)) if total else F.col("cap").cast("double")
    return own.select("source", "source_size", target.alias("target"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return numbered_stage(spark, docs, sf_dir, seed).select(docs.columns)


def numbered_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the number of the copy (copy, from 0 on), which no two rows of one doc_id and text share."""
    plan = mixed(docs, seed).where("copies > 0").select("key", "copies")
    # rows of one key are equal in doc_id and text; each takes its own copies
    plan = written(plan.groupBy(F.col("key").alias("_key")).agg(F.sum("copies").alias("_copies")), "mix")
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), key.alias("_key"))
    same = written(keyed.groupBy("_key").count().where("count > 1").select("_key"), "same")
    rows = only_ids(keyed, same, "_key", "left_anti").unionByName(only_ids(keyed, same, "_key").dropDuplicates(["_key"]))
    taken = rows.join(plan.hint("merge"), "_key").select("_doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("copy"))
    return taken.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != "copy"], "copy")


QUERIES = {"op9_mixing": op9_mixing}
