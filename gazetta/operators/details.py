"""Records with their assets, and what a hit of a search leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.operators.assets import rank
from gazetta.operators.state import as_records


def details(records: DataFrame, assets: DataFrame) -> DataFrame:
    """circular and assets of each record: its row as it is shown, and its assets in their order; an empty array where there are none."""
    key = F.struct(rank().alias("_rank"), F.coalesce("archive_member_path", F.lit("")).alias("_member"), F.col("file_path").alias("_path"))
    own = assets.groupBy(F.col("circular_id").alias("_record")).agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), F.struct(*assets.columns).alias("asset")))).alias("a"))
    shown = as_records(records)
    both = shown.select(F.struct(*shown.columns).alias("circular")).join(own, F.col("circular.id") == F.col("_record"), "left")
    none = F.array().cast(own.select(F.transform("a", lambda x: x["asset"]).alias("x")).schema["x"].dataType)
    return both.select("circular", F.coalesce(F.transform("a", lambda x: x["asset"]), none).alias("assets"))


def detail(records: DataFrame, assets: DataFrame, record_id: str) -> DataFrame:
    """The same of one record; no row where there is no such record."""
    return details(records.where(F.col("id") == record_id), assets.where(F.col("circular_id") == record_id))


def summaries(records: DataFrame, assets: DataFrame) -> DataFrame:
    """id, status, number of assets and their bytes of each record."""
    own = assets.groupBy(F.col("circular_id").alias("id")).agg(F.count("*").alias("n_assets"), F.sum("file_size_bytes").alias("bytes"))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return records.join(own, "id", "left").select("id", "status", count("n_assets"), count("bytes"))


def of_hits(hits: DataFrame, records: DataFrame, assets: DataFrame) -> DataFrame:
    """chunk_id, score, circular and assets of each hit, by the record that its chunk names."""
    few = hits.select("chunk_id", "score", F.col("circular_db_id").alias("id"))
    # hits may be any number; Spark knows of a search's that they are few, and broadcasts them
    own = records.join(few.select("id").distinct(), "id", "left_semi")
    found = details(own, assets.join(few.select(F.col("id").alias("circular_id")).distinct(), "circular_id", "left_semi"))
    return found.join(few, F.col("circular.id") == F.col("id")).select("chunk_id", "score", "circular", "assets")
