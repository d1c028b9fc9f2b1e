"""Landed feed files as a stream: each micro-batch is one ingestion.

The state's upserts make a repeated batch harmless, and a published batch is
remembered by its number.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazetta.options import Options
from gazetta.plans.ingest import ingest
from gazetta.sources import json_feed
from gazetta.store import Store


def landed_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    own = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(path)
    return own.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def start(store: Store, path: str, checkpoint: str, downloads: Callable[[DataFrame], DataFrame], today: Callable[[], date], now: Callable[[], Column], options: Options | None = None) -> StreamingQuery:
    """Runs over what has landed and ends; `downloads` gives the contents for detected items."""

    def each(batch: DataFrame, number: int) -> None:
        found = json_feed.detected(batch, now())
        ingest(store, found, downloads(found), today(), now(), options, number)

    stream = landed_stream(store.spark, path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Items by source and time window, late ones up to the watermark."""
    return events.withWatermark("detected_at", watermark).groupBy(F.window("detected_at", window), "source").agg(F.count("*").alias("n"))
