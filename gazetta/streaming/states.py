"""The lifecycle of items as keyed state of a stream.

Events of an item are detections (what it looks like now) and outcomes (fetched, or
failed with an error). Each key keeps one row, whatever order its events come in: the
fields of the last detection and the status of the last outcome, by pos. A failed item
has a timer in event time, and when the watermark passes it without a newer outcome the
item is due again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENT = "source string, source_item_key string, pos long, at timestamp, kind string, title string, pdf_url string, error string"
_STATE = "title string, pdf_url string, status string, error string, attempts int, seen long, told long, timer long"
STATE = "source string, source_item_key string, title string, pdf_url string, status string, error_message string, attempts int, due boolean"
_TOLD = Row(*[c.split()[0] for c in STATE.split(", ")])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """State of one item; retry_ms after the last failure it is due again."""

    def __init__(self, retry_ms: int = 3_600_000):
        self.retry_ms = retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.item = handle, handle.getValueState("item", _STATE)

    def _kept(self) -> list:
        return list(self.item.get()) if self.item.exists() else [None, None, "DISCOVERED", None, 0, -1, -1, 0]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        title, url, status, error, attempts, seen, told, timer = self._kept()
        at = None
        for row in rows:
            if row["kind"] == "detected" and row["pos"] > seen:
                title, url, seen = row["title"], row["pdf_url"], row["pos"]
            elif row["kind"] == "outcome":
                attempts += 1
                if row["pos"] > told:
                    error, told, at = row["error"], row["pos"], row["millis"]
        if at is not None:  # the last outcome is among these rows
            status = "FETCHED" if error is None else "FAILED"
            if timer:
                self.handle.deleteTimer(timer)
            timer = 0 if error is None else at + self.retry_ms
            if timer:
                self.handle.registerTimer(timer)
        self.item.update((title, url, status, error, attempts, seen, told, timer))
        yield _TOLD(*key, title, url, status, error, attempts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        title, url, status, error, attempts, seen, told, _ = self._kept()
        self.item.update((title, url, status, error, attempts, seen, told, 0))
        yield _TOLD(*key, title, url, status, error, attempts, status == "FAILED")

    def close(self) -> None:
        pass


def states(events: DataFrame, retry_ms: int = 3_600_000, watermark: str = "7 days") -> DataFrame:
    """A row of STATE for each key and micro-batch in which it changed, of a stream of EVENT rows; those that are behind the watermark are left out."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker doesn't see what was sent to the executors
    keyed = events.withWatermark("at", watermark).withColumn("millis", F.unix_millis("at")).groupBy("source", "source_item_key")
    return keyed.transformWithState(statefulProcessor=Lifecycle(retry_ms), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def start(spark: SparkSession, landed: str, out: str, checkpoint: str, retry_ms: int = 3_600_000, watermark: str = "7 days", files: int = 100, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs over the events that have landed (Parquet files of EVENT rows) and ends; the changes of each batch are written under out once, by its number."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = states(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(landed), retry_ms, watermark)

        def each(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if then:
                then(batch, number)

        return stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The row of each key as it was told last."""
    told = spark.read.schema(f"{STATE}, batch long").parquet(out)
    rest = [c for c in told.columns if c not in ("source", "source_item_key", "batch")]
    last = told.groupBy("source", "source_item_key").agg(F.max_by(F.struct(*rest), F.struct("batch", "due")).alias("s"))
    return last.select("source", "source_item_key", "s.*")
