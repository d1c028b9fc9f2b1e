"""The chunk index: documents from records and texts, upserts, stale chunks, and the inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions.arrays import once
from gazetta.functions.normalize import chunk_key
from gazetta.functions.text import TOKEN, chunk_id, chunk_texts, tokens
from gazetta.schemas import CHUNKS

#: Columns of an asset that its chunks have.
ASSET = ["id", "asset_role", "file_path", "archive_member_path", "content_hash"]


def documents(records: DataFrame, assets: DataFrame, texts: DataFrame | None, indexed_at: Column, size: int = 1200, overlap: int = 200) -> DataFrame:
    """A row for each chunk of each asset's text (asset_id, text), with its record.

    Without texts, assets have a column text of their own, so no text is matched by the asset's id.
    """
    own = records.alias("r").join(assets.alias("a"), F.col("r.id") == F.col("a.circular_id"))
    own = own.withColumn("_text", F.col("a.text")) if texts is None else own.join(texts.alias("t"), F.col("a.id") == F.col("t.asset_id")).withColumn("_text", F.col("t.text"))
    key = chunk_key("r.source", "r.circular_id", "a.asset_role", "a.archive_member_path", "a.file_path")
    own = own.select("r.*", F.struct(*[F.col(f"a.{c}") for c in ASSET]).alias("a"), key.alias("_key"), F.posexplode(chunk_texts("_text", size, overlap)).alias("chunk_index", "chunk_text"))
    fixed = {
        "chunk_id": chunk_id("_key", "chunk_index", "chunk_text"), "circular_db_id": F.col("id"), "asset_id": F.col("a.id"), "asset_role": F.col("a.asset_role"),
        "file_path": F.col("a.file_path"), "archive_member_path": F.col("a.archive_member_path"), "content_hash": F.coalesce(F.nullif(F.col("a.content_hash"), F.lit("")), F.col("content_hash")), "indexed_at": indexed_at,
    }
    return own.select(*[fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHUNKS])


def decoded(source: DataFrame) -> DataFrame:
    """Stored documents as typed rows; what is optional and missing is empty."""
    fill = {"asset_id", "asset_role"}
    have = set(source.columns)
    return source.select(*[(F.coalesce(F.col(f.name), F.lit("")) if f.name in fill and f.name in have else F.lit("") if f.name in fill else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS])


def upserted(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks with the new ones in place of those with their ids; of new ones with one id the last index counts.

    Of rows with one id and one index (or, without an index, one id) the largest
    counts, so that replays agree. Old and new rows meet in one grouping, so each
    side is read once.
    """
    at = F.col("chunk_index") if "chunk_index" in new.columns else F.lit(0)
    rest = [c for c in chunks.columns if c != "chunk_id"]
    place = lambda is_new: F.struct(F.lit(is_new).alias("new"), (at if is_new else F.lit(0)).alias("at"), *rest).alias("row")
    both = chunks.select("chunk_id", place(False)).unionByName(new.select("chunk_id", place(True)))
    last = both.groupBy("chunk_id").agg(F.max("row").alias("row"))
    return last.select("chunk_id", *[F.col(f"row.{c}").alias(c) for c in rest]).select(chunks.columns)


def stale(chunks: DataFrame, records: DataFrame, active: DataFrame) -> DataFrame:
    """chunks of the records (id) that aren't active (chunk_id); all of them where none is."""
    own = chunks.join(records.select(F.col("id").alias("circular_db_id")), "circular_db_id", "left_semi")
    return own.join(active.select("chunk_id"), "chunk_id", "left_anti").select(chunks.columns)


def without(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("chunk_id"), "chunk_id", "left_anti").select(chunks.columns)


def without_record(chunks: DataFrame, record_id: str) -> DataFrame:
    return chunks.where(F.col("circular_db_id") != record_id)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.col("circular_db_id").alias("id")).agg(F.count("*").alias("n"))


def index_outcomes(records: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """id, n, ok and skipped_reason of records after indexing: those without an asset or without text stay pending."""
    own = records.select("id").join(chunk_counts(chunks), "id", "left").join(assets.select(F.col("circular_id").alias("id"), F.lit(True).alias("has")).distinct(), "id", "left")
    n = F.coalesce("n", F.lit(0))
    return own.select("id", n.alias("n"), (n > 0).alias("ok"), F.when(n > 0, F.lit(None)).when(F.col("has").isNull(), "no indexable asset").otherwise("no text").alias("skipped_reason"))


def batch_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))


def upsert_counts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """One row, success, failed and complete: how many of the new ids are stored with their text, how many aren't, and whether all are."""
    own = new.select("chunk_id", F.xxhash64("chunk_text").alias("_text")).groupBy("chunk_id").agg(F.collect_set("_text").alias("_texts"))
    there = stored.select("chunk_id", F.xxhash64("chunk_text").alias("_stored"))
    ok = F.coalesce(F.array_contains("_texts", F.col("_stored")), F.lit(False))
    counts = own.join(there, "chunk_id", "left").agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
    return counts.select("success", "failed", (F.col("failed") == 0).alias("complete"))


@dataclass(frozen=True)
class Inverted:
    """postings (term, chunk_id, tf, dl: tokens of the chunk), terms (term, df), and totals, one row (n: chunks, average: their tokens)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def inverted(chunks: DataFrame) -> Inverted:
    """Tables over chunks; each is computed from them, so save and load them for use again and again."""
    # rows that repeat a chunk meet before their words are parted, so a word's row is made where the chunk is
    rows = chunks.groupBy("chunk_id", "chunk_text").agg(F.count("*").alias("_times"))
    found = rows.select("chunk_id", "_times", tokens("chunk_text").alias("tokens"))
    counted = found.select("chunk_id", F.size("tokens").cast("bigint").alias("dl"), "_times", F.explode(_counts(F.col("tokens"))).alias("t"))
    postings = counted.select(F.col("t.term").alias("term"), "chunk_id", (F.col("t.tf") * F.col("_times")).alias("tf"), "dl")
    return Inverted(postings, term_statistics(postings), totals(chunks))


def _counts(words: Column) -> Column:
    """term and tf of the distinct ones of an array of words."""

    def counted(x: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == F.size(x)) | (F.get(x, i) != F.get(x, i - 1)))
        last = lambda e, k: F.when(k == 0, 0).otherwise(F.get(e, k - 1))
        of = once(ends, lambda e: F.transform(e, lambda end, k: F.struct(F.get(x, end - 1).alias("term"), (end - last(e, k)).cast("bigint").alias("tf"))))
        return F.when(F.size(x) > 0, of)

    return once(F.sort_array(words), counted)


def term_statistics(postings: DataFrame) -> DataFrame:
    """term, df (chunks) and cf (places)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def totals(chunks: DataFrame) -> DataFrame:
    """Number of chunks and their average number of tokens, of which those without any count too."""
    return chunks.select(F.regexp_count(F.lower("chunk_text"), F.lit(TOKEN)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("average"))


def save_inverted(index: Inverted, path: str, partitions: int = 200) -> Inverted:
    """Writes the index and gives it as read. Each task sorts the postings that it has by term and writes a file, so no posting goes
    through an exchange, a query reads few pages of each of at most so many files, and a frequent term is many tasks' work."""
    spark = index.postings.sparkSession
    index.postings.coalesce(partitions).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    term_statistics(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")
    return load_inverted(spark, path)


def load_inverted(spark: SparkSession, path: str) -> Inverted:
    return Inverted(*[spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "totals")])
