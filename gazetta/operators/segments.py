"""The chunk index as segments: tables that are written once and never changed.

A batch adds a segment with its chunks, their postings, and what it takes away from
older segments: the places of replaced and stale chunks, and their words, counted
below zero. So statistics of the index are sums over the segments, and a batch costs
what it changes. Segments of like size are merged, the newest ones first, so that
there are few of them.

    <path>/chunks/part=P     chunks, dealt by hash of the record, with block and slot (64 slots a block) and dl, their tokens
    <path>/postings/bucket=B term, block, n, impacts (the pairs of tf and dl that can score best), docs (slot, tf, dl)
    <path>/terms/bucket=B    term, df, cf
    <path>/dead              places (segment, block, slot) in older segments
    <path>/summary           sketches of the chunks: distinct texts, lengths
    <path>/frequent          the FREQUENT terms of the largest counts, of either sign

Searching reads the impacts of the query's terms first, which bound what any chunk of
a block can score, then the blocks that promise most, whose chunks give a score that
the best ones reach at least, and then only those other blocks whose bound reaches it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetta.functions.text import TOKEN, query_tokens, tokens
from gazetta.operators.search import bm25, checked, filtered
from gazetta.session import removed

#: Bits of the slot in a block, and of the block in a part (64 chunks a block; Spark counts rows of a partition in 33 bits).
SLOT, IN_PART = 6, 27
#: Chunks of a part, and for each bucket of terms, in mean; buckets at most (each part has a file in every bucket).
PART_CHUNKS, BUCKET_CHUNKS, BUCKETS = 20_000, 20_000, 16
#: Chunks whose words are counted together.
TOGETHER = 4096
#: So many segments of one size class are merged into one of the next.
FANOUT = 8
#: Terms of a segment whose counts are kept apart.
FREQUENT = 1000
#: Rows that a lookup names one by one; more are joined.
NAMED = 1000
#: Narrow rows that are broadcast at most.
BROADCAST_ROWS = 1_000_000

PLACE = ["segment", "block", "slot"]
_OWN = ["part", "block", "slot", "dl"]


@dataclass(frozen=True)
class Segment:
    """Where a segment is, how many chunks it holds, and what it adds to the index: n chunks with tokens, less what it takes away (dead places)."""

    name: str
    path: str
    docs: int
    n: int
    tokens: int
    buckets: int
    dead: int
    #: No term that isn't among the frequent ones has a larger count here.
    floor: int = 0
    #: Parts that records are dealt to by hash; 0: it isn't told.
    parts: int = 0


@dataclass(frozen=True)
class Index:
    """Segments, the oldest first; columns: the schema of the chunks."""

    spark: SparkSession
    columns: T.StructType
    segments: tuple[Segment, ...] = ()

    @property
    def n(self) -> int:
        return sum(s.n for s in self.segments)

    @property
    def average(self) -> float:
        return sum(s.tokens for s in self.segments) / self.n if self.n else 0.0

    def told(self) -> list[dict]:
        return [asdict(s) for s in self.segments]

    @classmethod
    def of(cls, spark: SparkSession, columns: T.StructType, told: Iterable[dict]) -> Index:
        return cls(spark, columns, tuple(Segment(**t) for t in told))

    # ---- tables ----

    def _read(self, s: Segment, kind: str, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{s.path}/{kind}").withColumn("segment", F.lit(s.name))

    def _all(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def placed(self, segments: Iterable[Segment] | None = None) -> DataFrame:
        """Chunks with segment, part, block, slot and dl, dead ones too."""
        schema = T.StructType([*self.columns, *[T.StructField(c, t) for c, t in zip(_OWN, (T.IntegerType(), T.LongType(), T.IntegerType(), T.LongType()), strict=True)]])
        frames = [self._read(s, "chunks", schema) for s in (self.segments if segments is None else segments) if s.docs]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], T.StructType([*schema, T.StructField("segment", T.StringType())]))

    def dead(self) -> DataFrame:
        """Places of chunks that count no more."""
        frames = [self.spark.read.schema("segment string, block long, slot int").parquet(f"{s.path}/dead") for s in self.segments if s.dead]
        return self._all(frames, "segment string, block long, slot int")

    def alive(self, places: DataFrame) -> DataFrame:
        """The rows of places (segment, block, slot, ...) that aren't dead."""
        many = sum(s.dead for s in self.segments)
        if not many:
            return places
        blocks = sum(-(-s.docs // (1 << SLOT)) + (s.parts or 1) for s in self.segments)  # at most
        own = self.dead().where(F.col("segment").isin([s.name for s in self.segments]))
        return _at(places, own, min(many, blocks), "left_anti")

    def chunks(self) -> DataFrame:
        """The chunks of the index."""
        return self.alive(self.placed()).select(self.columns.names)

    def postings(self, terms: list[str]) -> DataFrame:
        """segment, term, block, n, impacts and docs of the terms."""
        schema = "term string, block long, n int, impacts array<struct<tf: int, dl: int>>, docs array<struct<slot: int, tf: int, dl: int>>, bucket int"
        frames = [self._read(s, "postings", schema).where(_of_terms(terms, s.buckets)) for s in self.segments if s.docs]
        return self._all(frames, f"{schema}, segment string")

    def terms(self, only: list[str] | None = None) -> DataFrame:
        """term, df and cf, of some terms or of all."""
        schema = "term string, df long, cf long, bucket int"
        frames = [self._read(s, "terms", schema) for s in self.segments]
        frames = frames if only is None else [f.where(_of_terms(only, s.buckets)) for f, s in zip(frames, self.segments, strict=True)]
        return self._all(frames, f"{schema}, segment string").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def summary(self, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
        """One row: n and average (exact), about how many texts are distinct, and about how long chunks are at the quantiles.

        Reads a row for each segment. Chunks that were replaced count until their
        segment is merged.
        """
        schema = "distinct binary, lengths binary"
        rows = self._all([self.spark.read.schema(schema).parquet(f"{s.path}/summary") for s in self.segments if s.docs], schema)
        told = rows.agg(F.hll_union_agg("distinct").alias("distinct"), F.collect_list("lengths").alias("lengths"))  # a sketch for each segment
        one = F.aggregate(F.slice("lengths", F.lit(2), F.size("lengths")), F.get("lengths", F.lit(0)), lambda a, x: F.kll_sketch_merge_bigint(a, x))
        told = told.select(F.hll_sketch_estimate("distinct").alias("distinct"), one.alias("lengths"))
        at = F.array(*[F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(q))) for q in quantiles])
        return told.select(F.lit(self.n).alias("n"), F.lit(self.average).alias("average"), "distinct", F.when(F.col("lengths").isNotNull(), at).alias("lengths"))

    def frequent(self, k: int = 20) -> DataFrame:
        """The terms that may occur most, with the least and the most that their count can be. Reads FREQUENT rows of each segment."""
        schema = "term string, cf long"
        floors = sum(s.floor for s in self.segments)
        frames = [self.spark.read.schema(schema).parquet(f"{s.path}/frequent").withColumn("floor", F.lit(s.floor).cast("long")) for s in self.segments]
        own = self._all(frames, f"{schema}, floor long").groupBy("term").agg(F.sum("cf").alias("cf"), (F.lit(floors) - F.sum("floor")).alias("open"))
        return own.select("term", F.greatest(F.lit(0), F.col("cf") - F.col("open")).alias("least"), (F.col("cf") + F.col("open")).alias("most")).orderBy(F.desc("most"), "term").limit(k)

    # ---- changes ----

    def of_records(self, records: DataFrame, only: list[str] | None = None) -> DataFrame:
        """The chunks, with their places, of records (id), or some of their columns. A record is in one part, so few files are read for a batch."""
        own = records.select(F.col("id").alias("circular_db_id")).distinct()
        some = [r[0] for r in own.limit(NAMED + 1).collect()]
        if len(some) > NAMED:
            chunks = self.placed()
            chunks = chunks if only is None else chunks.select(only)
            return self.alive(chunks.join(own, "circular_db_id", "left_semi").select(chunks.columns))
        frames = [self.placed([s]).where(_in_parts(some, s.parts)) for s in self.segments if s.docs]
        chunks = (reduce(DataFrame.unionByName, frames) if frames else self.placed()).where(F.col("circular_db_id").isin(some))
        return self.alive(chunks if only is None else chunks.select(only))

    def updated(self, new: DataFrame, path: str, stale_of: DataFrame | None = None, fanout: int = FANOUT, over: Iterable[str] = ()) -> Index:
        """The index after a batch: new chunks (a written table, each id once) in place of those with their ids.

        stale_of: records (id) of which all chunks go that aren't among the new ones.
        path is a folder under which the segment gets one of its own. A record has no
        chunk with the id of a chunk of another record. over: folders that are deleted
        when the chunks are written, as new is of no use any more.
        """
        ids = new.select("chunk_id")
        dead = None
        if self.segments:
            records = new.select(F.col("circular_db_id").alias("id"))
            records = records if stale_of is None else records.unionByName(stale_of.select("id"))
            old = self.of_records(records, ["chunk_id", "circular_db_id", *PLACE, "dl"])  # without texts
            dead = old.join(ids, "chunk_id", "left_semi").select(*PLACE, "dl")
            if stale_of is not None:
                gone = old.join(stale_of.select(F.col("id").alias("circular_db_id")).distinct(), "circular_db_id", "left_semi").join(ids, "chunk_id", "left_anti")
                dead = dead.unionByName(gone.select(*PLACE, "dl"))
        return self._with(written_segment(self.spark, new.select(self.columns.names), path, dead, self.placed(), over)).merged(path, fanout)

    def without_records(self, records: DataFrame, path: str) -> Index:
        """The index without the chunks of records (id)."""
        gone = self.of_records(records, ["circular_db_id", *PLACE, "dl"])
        return self._with(written_segment(self.spark, self.spark.createDataFrame([], self.columns), path, gone, self.placed()))

    def _with(self, s: Segment) -> Index:
        return replace(self, segments=(*self.segments, s)) if s.docs or s.dead else self

    def merged(self, path: str, fanout: int = FANOUT, replacing: bool = False) -> Index:
        """The index with its newest segments merged as long as there are so many of one size class.

        replacing: tables of the segments that are merged are deleted as soon as the
        new one needs them no more, so nothing may read this index any more, nor a
        store name it, also if merging fails.
        """
        index = self
        while (first := due(index.segments, fanout)) is not None:
            index = index._joined(first, path, replacing)
        return index

    def compacted(self, path: str, replacing: bool = False) -> Index:
        """The index as one segment, without what was taken away. replacing: as with merged."""
        return self._joined(0, path, replacing) if self.segments else self

    def _joined(self, first: int, path: str, replacing: bool = False) -> Index:
        """The index with its segments from the first one on as one."""
        old, own = self.segments[:first], self.segments[first:]
        merging = replace(self, segments=own)
        live = self.alive(merging.placed()).select(self.columns.names)
        kept = merging.dead().where(~F.col("segment").isin([s.name for s in own]))
        sums = reduce(DataFrame.unionByName, [self._read(s, "terms", "term string, df long, cf long, bucket int") for s in own])
        gone = own if replacing else ()
        for s in gone:
            removed(self.spark, f"{s.path}/postings")  # words are counted anew, as chunks have new places
        new = _written(self.spark, live, path, kept, sums.select("term", "df", "cf"), over=[f"{s.path}/chunks" for s in gone])
        for s in gone:
            removed(self.spark, s.path)
        return replace(self, segments=(*old, replace(new, n=sum(s.n for s in own), tokens=sum(s.tokens for s in own))))


def _at(rows: DataFrame, places: DataFrame, blocks: int, how: str) -> DataFrame:
    """The rows (segment, block, slot, ...) at places (left_semi) or elsewhere (left_anti); places are in so many blocks at most.

    A block's slots are the bits of one number, so a broadcast row stands for up to 64 chunks, whose texts stay where they are.
    """
    slots = places.groupBy(F.col("segment").alias("_segment"), F.col("block").alias("_block")).agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("_slots"))
    here = (F.col("segment") == F.col("_segment")) & (F.col("block") == F.col("_block")) & (F.getbit("_slots", F.col("slot")) == 1)
    return rows.join(F.broadcast(slots) if blocks <= BROADCAST_ROWS else slots, here, how).select(rows.columns)


def _of_terms(terms: list[str], buckets: int) -> Column:
    """The condition for rows of terms, with the folders in which they are."""
    here = F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms])
    return F.col("term").isin(terms) & F.array_contains(here, F.col("bucket"))


def _in_parts(ids: list[str], parts: int) -> Column:
    """The condition for the parts in which records with these ids are."""
    return F.array_contains(F.array(*[_part(F.lit(i), parts) for i in ids]), F.col("part")) if ids and parts else F.lit(True)


def _part(record: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(record), F.lit(parts)).cast("int")


def size_class(docs: int, fanout: int = FANOUT) -> int:
    """0 for a batch of up to some hundreds of chunks, and one more for each time it is so many times as large."""
    return max(0, math.floor(math.log(max(docs, 1) / 256, fanout)) + 1)


def due(segments: tuple[Segment, ...], fanout: int = FANOUT) -> int | None:
    """From which segment on to merge: the newest ones of a class or below, where there are fanout of that class; None if nothing is due."""
    classes = [size_class(s.docs, fanout) for s in segments]
    for c in sorted(set(classes)):
        first = len(classes)
        while first and classes[first - 1] <= c:
            first -= 1
        if classes[first:].count(c) >= fanout:
            return first
    return None


def written_segment(spark: SparkSession, chunks: DataFrame, path: str, dead: DataFrame | None = None, placed: DataFrame | None = None, over: Iterable[str] = ()) -> Segment:
    """A segment of chunks that takes dead (places with dl) away from older ones, of which placed has the texts."""
    if dead is None:
        return _written(spark, chunks, path, None, None, over=over)
    dead = dead.select(*PLACE, "dl").persist()
    gone = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.count_distinct("segment", "block")).first()
    places = dead.select(PLACE)
    texts = _at(placed.select(*PLACE, "chunk_text"), places, gone[2], "left_semi")
    away = texts.select(tokens("chunk_text").alias("tokens")).mapInArrow(_taken, "term string, df long, cf long")  # summed up by batches, then with the terms
    out = _written(spark, chunks, path, places, None, away, over)
    dead.unpersist()
    return replace(out, n=out.docs - gone[0], tokens=out.tokens - gone[1])


def _written(spark: SparkSession, chunks: DataFrame, path: str, dead: DataFrame | None, terms: DataFrame | None, away: DataFrame | None = None, over: Iterable[str] = ()) -> Segment:
    """Writes a segment. terms: the sums of its terms, else they are counted, with those of away (df and cf below zero).

    over: folders of which only the chunks are made; they are deleted when those are written.
    """
    name = uuid.uuid4().hex
    path = f"{path}/{name}"
    many = chunks.count()
    parts, buckets = -(-many // PART_CHUNKS) or 1, min(BUCKETS, -(-many // BUCKET_CHUNKS) or 1)
    columns = chunks.schema
    sort = ["circular_db_id", *(["chunk_index"] if "chunk_index" in columns.names else []), "chunk_id"]
    row = (F.row_number().over(Window.partitionBy("part").orderBy(*sort)) - 1).cast("long")
    own = _by_part(chunks.withColumn("part", _part(F.col("circular_db_id"), parts)), parts).withColumn("_row", row)
    block = F.shiftleft(F.col("part").cast("long"), IN_PART).bitwiseOR(F.shiftright("_row", SLOT))
    own = own.select(*columns.names, "part", block.alias("block"), F.col("_row").bitwiseAND((1 << SLOT) - 1).cast("int").alias("slot"), F.regexp_count(F.lower("chunk_text"), F.lit(TOKEN)).cast("long").alias("dl"))
    own.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/chunks")
    for folder in over:
        removed(spark, folder)
    # what was written is read again, so that places can't move
    schema = T.StructType([*columns, T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("dl", T.LongType())])
    own = spark.read.schema(schema).parquet(f"{path}/chunks") if many else spark.createDataFrame([], schema)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    if many:
        stored = _by_file(spark).read.schema(schema).parquet(f"{path}/chunks")
        _postings(stored).select("*", bucket).sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    if terms is None:
        terms = spark.read.schema("term string, n int, docs array<struct<slot: int, tf: int, dl: int>>").parquet(f"{path}/postings") if many else spark.createDataFrame([], "term string, n int, docs array<struct<slot: int, tf: int, dl: int>>")
        terms = terms.select("term", F.col("n").cast("long").alias("df"), F.aggregate("docs.tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("cf"))
        terms = terms if away is None else terms.unionByName(away)
    terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df != 0 OR cf != 0")
    terms.select("*", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    counts = spark.read.schema("term string, cf long").parquet(f"{path}/terms")
    counts.orderBy(F.desc(F.abs("cf")), "term").limit(FREQUENT).write.parquet(f"{path}/frequent")
    kept = spark.read.schema("term string, cf long").parquet(f"{path}/frequent").agg(F.count("*"), F.min(F.abs("cf"))).first()
    own.agg(F.hll_sketch_agg("chunk_text").alias("distinct"), F.kll_sketch_agg_bigint("dl").alias("lengths")).write.parquet(f"{path}/summary")
    gone = 0
    if dead is not None:
        dead.select(PLACE).write.parquet(f"{path}/dead")
        gone = spark.read.schema("segment string, block long, slot int").parquet(f"{path}/dead").count()
    total = own.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0] if many else 0
    return Segment(name, path, many, many, total, buckets, gone, kept[1] if kept[0] == FREQUENT else 0, parts)


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    """rows (part, ...) with each part in one task."""
    return rows.repartitionByRange(parts, "part") if parts > 1 else rows.coalesce(1)


def _by_file(spark: SparkSession) -> SparkSession:
    """A session that reads each file in a task of its own, so that a task sorts the postings of one part."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    return own


def _taken(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """term, df and cf, below zero, of the words of some chunks (tokens)."""
    for batch in batches:
        words = pc.list_flatten(batch.column(0)).dictionary_encode()
        term = words.indices.to_numpy().astype(np.int64)
        each = np.unique(pc.list_parent_indices(batch.column(0)).to_numpy() * max(1, len(words.dictionary)) + term) % max(1, len(words.dictionary))
        df, cf = (-np.bincount(x, minlength=len(words.dictionary)) for x in (each, term))
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(df), pa.array(cf)], names=["term", "df", "cf"])


_POSTING = "term string, block long, n int, impacts array<struct<tf: int, dl: int>>, docs array<struct<slot: int, tf: int, dl: int>>"


def _postings(chunks: DataFrame) -> DataFrame:
    """term, block, n, impacts and docs of chunks with places, where those of a block stand together.

    Words are counted where the chunks are read, so neither texts nor postings go
    through an exchange. Where a file is read by several tasks (a part of more than
    one row group), a block can have two rows of a term, with other slots each.
    """
    return chunks.select("block", "slot", "dl", tokens("chunk_text").alias("tokens")).mapInArrow(_blocks, _POSTING)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Postings of chunks; the last block of some waits for the next ones, as it may go on there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            rows = pa.Table.from_batches([*held, batch.slice(at, TOGETHER)])
            block = rows["block"].to_numpy()
            others = np.flatnonzero(block != block[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            yield from _counted(rows.slice(0, cut)).to_batches() if cut else []
            held = rows.slice(cut).to_batches()
    if held:
        yield from _counted(pa.Table.from_batches(held)).to_batches()


def _counted(part: pa.Table) -> pa.Table:
    """Postings of whole blocks."""
    block, slot, dl = (part[c].to_numpy().astype(np.int64) for c in ("block", "slot", "dl"))
    lists = part["tokens"].combine_chunks()
    words = pc.list_flatten(lists).dictionary_encode()
    order = np.lexsort((slot, block))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # a number for each word and chunk, which rises with the word, the block and the slot
    code = words.indices.to_numpy().astype(np.int64) * len(order) + rank[pc.list_parent_indices(lists).to_numpy()]
    code, tf = np.unique(code, return_counts=True)
    term, chunk = code // max(1, len(order)), order[code % max(1, len(order))]
    block, slot, dl = block[chunk], slot[chunk], dl[chunk]
    head = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])][: len(term)])
    size = np.diff(np.r_[head, len(term)])
    # tf rises and dl falls with the score, so of each tf the shortest counts, if no larger tf is as short
    group = np.repeat(np.arange(len(head)), size)
    best = np.lexsort((dl, -tf, group))
    low = dl[best] - group[best] * (dl.max(initial=0) + 1)  # any of a group is lower than all of the groups before
    best = best[np.r_[True, low[1:] < np.minimum.accumulate(low)[:-1]][: len(low)]]

    def listed(sizes: np.ndarray, **fields: np.ndarray) -> pa.Array:
        edge = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.ListArray.from_arrays(edge, pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in fields.values()], list(fields)))

    impacts = listed(np.bincount(group[best], minlength=len(head)), tf=tf[best], dl=dl[best])
    columns = [words.dictionary.take(pa.array(term[head])), pa.array(block[head]), pa.array(size.astype(np.int32)), impacts, listed(size, slot=slot, tf=tf, dl=dl)]
    return pa.table(columns, names=["term", "block", "n", "impacts", "docs"])


# ---- search ----------------------------------------------------------------


@dataclass(frozen=True)
class Found:
    """The best chunks, best first, and how many blocks there are of the query's terms and how many of them were read."""

    hits: DataFrame
    blocks: int
    read: int


def top(index: Index, query: str, filters: dict[str, list] | None = None, size: int = 40) -> Found:
    """The best chunks for a query with their score, ties by chunk_id: those that a scan of all chunks finds.

    What comes to the driver is a row for each term, `size` scores, and the parts in
    which the best chunks are.
    """
    spark, words = index.spark, query_tokens(checked(query))
    terms = sorted(set(words))
    df = {r["term"]: r["df"] for r in index.terms(terms).collect()} if terms else {}
    nothing = index.chunks().limit(0).select(F.lit(0.0).alias("score"), *index.columns.names)
    if not df or size <= 0 or any(v is not None and not list(v) for v in (filters or {}).values()):
        return Found(nothing, 0, 0)
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for t, v in values.items() for x in (t, v)]), F.col("term"))

    def score(tf: Column, dl: Column) -> Column:
        return bm25(tf, dl, of(df), F.lit(index.n), F.lit(index.average), of({t: words.count(t) for t in df}))

    known = index.postings(list(df))
    most = F.array_max(F.transform("impacts", lambda x: score(x["tf"], x["dl"])))
    bounds = known.select("segment", "block", most.alias("most")).groupBy("segment", "block").agg(F.sum("most").alias("bound")).persist()
    wanted = {k: v for k, v in (filters or {}).items() if v is not None}

    def scored(blocks: DataFrame, few: bool) -> DataFrame:
        """segment, block, slot and score of the chunks of blocks that count."""
        hits = known.join(F.broadcast(blocks) if few else blocks, ["segment", "block"]).select("segment", "block", "term", F.explode("docs").alias("d"))
        # summed up in the order of the terms, so that equal scores are equal to the last digit
        part = F.struct("term", score(F.col("d.tf"), F.col("d.dl")).alias("score"))
        parts = hits.groupBy("segment", "block", F.col("d.slot").alias("slot")).agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a part for each term
        own = index.alive(parts.select(*PLACE, F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["score"]).alias("score")))
        return own.join(filtered(index.placed(), wanted).select(PLACE), PLACE, "left_semi") if wanted else own

    def least(scores: DataFrame) -> float:
        """The last of the `size` best scores; 0 if there are fewer."""
        best = [r[0] for r in scores.select("score").orderBy(F.desc("score")).limit(size).collect()]
        return best[-1] if len(best) == size else 0.0

    # as many blocks as chunks are wanted, those that promise most
    first = spark.createDataFrame(bounds.orderBy(F.desc("bound"), "segment", "block").limit(size).select("segment", "block").collect(), "segment string, block long")
    early = scored(first, True).persist()
    bar = least(early)
    rest = bounds.where(F.col("bound") * (1 + 1e-9) >= bar).join(F.broadcast(first), ["segment", "block"], "left_anti").select("segment", "block").persist()
    blocks, more, begun = bounds.count(), rest.count(), first.count()
    best = early.unionByName(scored(rest, more <= BROADCAST_ROWS)) if more else early
    kept = best.where(F.col("score") >= bar).persist()
    best = kept.where(F.col("score") >= least(kept)).withColumn("part", F.shiftright("block", IN_PART).cast("int"))
    at: dict[str, set[int]] = {}
    for r in best.select("segment", "part").distinct().collect():
        at.setdefault(r["segment"], set()).add(r["part"])
    few = best.limit(NAMED + 1).collect()
    places = spark.createDataFrame(few, best.schema) if len(few) <= NAMED else best
    named = {s: sorted({r["block"] for r in few if r["segment"] == s}) for s in at} if len(few) <= NAMED else {}
    frames = []
    for s in index.segments:
        if s.name in at:
            own = index.placed([s]).where(F.col("part").isin(sorted(at[s.name])))
            frames.append(own.where(F.col("block").isin(named[s.name])) if named else own)
    if not frames:
        return Found(nothing, blocks, begun)
    places = places.select(*PLACE, "score")
    rows = reduce(DataFrame.unionByName, frames).join(F.broadcast(places) if len(few) <= NAMED else places, PLACE)
    hits = rows.orderBy(F.desc("score"), "chunk_id").limit(size).select("score", *index.columns.names)
    for frame in (early, rest, bounds, *([kept] if len(few) <= NAMED else [])):
        frame.unpersist()
    return Found(hits, blocks, begun + more)
