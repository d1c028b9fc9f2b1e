"""Event-time sessions of a stream or a table, without repeated events and with late rows counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_events(events: DataFrame, ids: list[str], at: str, watermark: str) -> DataFrame:
    """Each event once: of a stream as long as the watermark lets a repeat in, of a table for good."""
    if events.isStreaming:
        return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark(ids)
    return events.dropDuplicates(ids)


def sessions(events: DataFrame, keys: list[str], at: str, gap: str, watermark: str = "1 day", ids: list[str] | None = None) -> DataFrame:
    """keys, first and last time, and events of each session: events of a key with no more than gap between neighbours.

    Of a stream (append mode) a session is told when the watermark has passed its end,
    and events behind the watermark are left out; `late_rows` counts them.
    """
    own = distinct_events(events, ids, at, watermark) if ids else events.withWatermark(at, watermark) if events.isStreaming else events
    found = own.groupBy(*keys, F.session_window(at, gap).alias("_session")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"))
    return found.select(*keys, "first", "last", "events")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has left out because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
