"""Sources by name. A source gives detected items of a range of dates as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.options import Options
from gazetta.sources import html_feed, json_feed
from gazetta.sources.live import detail_pages, read_live


class Source(Protocol):
    """What a source offers; the engine's extension point."""

    name: str

    def detect(self, spark: SparkSession, start: date, end: date, now: Column) -> DataFrame: ...

    def document_url(self, circular_id: str) -> str: ...

    def parse_id(self, raw: str) -> str: ...


class Registry:
    def __init__(self) -> None:
        self._made: dict[str, Callable[[], Source]] = {}
        self._kept: dict[str, Source] = {}

    def register(self, make: Callable[[], Source], name: str | None = None) -> Callable[[], Source]:
        self._made[(name or make.name).upper()] = make
        return make

    def get(self, name: str) -> Source:
        key = name.upper()
        if key not in self._made:
            raise KeyError(f"no source {name}; there are {', '.join(self.names())}")
        if key not in self._kept:
            self._kept[key] = self._made[key]()
        return self._kept[key]

    def names(self) -> list[str]:
        return sorted(self._made)

    def enabled(self, names: tuple[str, ...] = ()) -> list[Source]:
        """The named sources in order, or all by name."""
        return [self.get(n) for n in (names or self.names())]


SOURCES = Registry()


class JsonFeed:
    """The JSON feed. read gives feed, page and body for a range of dates."""

    name = json_feed.SOURCE

    def __init__(self, read: Callable[..., DataFrame] = read_live):
        self.read = read

    def detect(self, spark: SparkSession, start: date, end: date, now: Column) -> DataFrame:
        payloads = self.read(spark, "json", start, end).select(F.lit(f"{start}..{end}").alias("file"), F.col("body").alias("payload"))
        return json_feed.detected(payloads, now)

    def document_url(self, circular_id: str) -> str:
        return json_feed.PDF_URL.format(circular_id)

    def parse_id(self, raw: str) -> str:
        return raw.replace("/", "").strip().upper()


class HtmlFeed:
    """The paginated HTML feed with its detail pages."""

    name = html_feed.SOURCE

    def __init__(self, read: Callable[..., DataFrame] = read_live, get: Callable[[str], str] | None = None, options: Options | None = None):
        self.read, self.get, self.options = read, get, options

    def detect(self, spark: SparkSession, start: date, end: date, now: Column) -> DataFrame:
        pages = self.read(spark, "html", start, end).select(F.lit(f"{start}..{end}").alias("run"), "page", F.col("body").alias("html"))
        rows = html_feed.listing_rows(html_feed.read_pages(pages), F.lit(start), F.lit(end))
        return html_feed.detected(rows, detail_pages(rows, self.options, self.get), now).drop("run")

    def document_url(self, circular_id: str) -> str:
        return html_feed.PDF_URL.format(circular_id)

    def parse_id(self, raw: str) -> str:
        return " ".join(raw.split())


SOURCES.register(JsonFeed)
SOURCES.register(HtmlFeed)
