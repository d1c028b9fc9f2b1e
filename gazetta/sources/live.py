"""Live feeds as a Python data source, to read as a table or as a stream: one partition for each feed and stretch of days.

    register(spark)
    spark.read.format("gazetta_feed").load().where("feed = 'json' AND first >= DATE '2026-04-01' AND last <= DATE '2026-04-06'")
    spark.readStream.format("gazetta_feed").option("from", "2026-04-01").load()
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from gazetta.options import Options
from gazetta.sources import html_feed, json_feed
from gazetta.sources.assets import content_or_placeholder

HEADERS = {"User-Agent": "Mozilla/5.0"}


def fetch(url: str, data: bytes | None = None, referer: str = "", timeout: int = 30, errors: str = "strict") -> str:
    return content_of(url, data, referer, timeout).decode("utf-8", errors)


def content_of(url: str, data: bytes | None = None, referer: str = "", timeout: int = 30) -> bytes:
    with urlopen(Request(url, data=data, headers=HEADERS | {"Referer": referer}), timeout=timeout) as r:
        return r.read()


def with_retries(call: Callable[[], str], attempts: int = 3, backoff: float = 2.0, wait: Callable[[float], None] = time.sleep) -> str:
    """The call's result; after a failure it waits longer each time, and the last error is raised."""
    for k in range(1, max(1, attempts) + 1):
        try:
            return call()
        except Exception:
            if k >= max(1, attempts):
                raise
            wait(backoff * k)
    raise AssertionError


def pages(get: Callable[[int], str], describe: Callable[[str], tuple[str, int, bool]]) -> Iterator[tuple[int, str]]:
    """Pages from the first until one repeats, is empty, or has no next; describe: signature, rows, more."""
    seen: set[str] = set()
    page = 1
    while True:
        markup = get(page)
        mark, rows, more = describe(markup)
        if mark in seen or not rows:
            return
        seen.add(mark)
        yield page, markup
        if not more:
            return
        page += 1


class _Feed(InputPartition):
    """A feed's stretch of days, both ends included."""

    def __init__(self, feed: str, first: date, last: date):
        super().__init__(feed)
        self.feed, self.first, self.last = feed, first, last


class _Reading:
    """What reading a table and reading a stream of pages share."""

    def __init__(self, options: dict):
        self.feeds = options.get("feed", "json,html").split(",")
        self.timeout = int(options.get("timeout", 30))
        self.days, self.base = max(1, int(options.get("days", 31))), options.get("base")

    def stretches(self, first: date, last: date) -> list[_Feed]:
        """Partitions of a closed range of days."""
        starts = range(0, (last - first).days + 1, self.days)
        return [_Feed(f, first + timedelta(n), min(last, first + timedelta(n + self.days - 1))) for f in self.feeds for n in starts]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        import re

        first, last = partition.first, partition.last
        at = lambda url, base: url.replace(base, self.base, 1) if self.base else url
        if partition.feed == "json":
            yield "json", first, last, 1, fetch(at(json_feed.listing_url(first, last), json_feed.BASE), referer=f"{json_feed.BASE}/", timeout=self.timeout)
            return
        row = re.compile(html_feed.ROW.removeprefix("(?i)"), re.I)

        def describe(markup: str) -> tuple[str, int, bool]:
            found = row.findall(markup)
            mark = "|".join([*found[0][:2], *found[-1][:2], str(len(found))]) if found else ""
            return mark, len(found), "title='Next'" in markup or 'title="Next"' in markup

        get = lambda page: fetch(at(html_feed.LISTING_URL, html_feed.BASE), urlencode(html_feed.listing_form(first, last, page)).encode(), f"{html_feed.BASE}/", self.timeout, "ignore")
        for page, markup in pages(get, describe):
            yield "html", first, last, page, markup


class FeedReader(_Reading, DataSourceReader):
    """Pages of a range of days. Conditions on feed, first and last become the requests that are made."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.first, self.last = (date.fromisoformat(options[x]) if x in options else None for x in ("from", "to"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name == "feed" and isinstance(f, EqualTo | In):
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.feeds = [x for x in self.feeds if x in wanted]
            elif name == "first" and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                day = f.value + timedelta(isinstance(f, GreaterThan))
                self.first = max(self.first or day, day)
            elif name == "last" and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                day = f.value - timedelta(isinstance(f, LessThan))
                self.last = min(self.last or day, day)
            yield f  # Spark looks at the rows again

    def partitions(self) -> list[InputPartition]:
        if self.first is None or self.last is None:
            raise ValueError("name the days by the options from and to, or by conditions on first and last")
        return self.stretches(self.first, self.last)


class FeedStreamReader(_Reading, DataSourceStreamReader):
    """Pages as days come: an offset is the day that will be read next.

    A batch begins so many days before it (option overlap, 1 by default), as items of
    the last day may have come later; the merge by their keys makes that harmless.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.end = options["from"], options.get("to")
        self.overlap = int(options.get("overlap", 1))

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        last = date.fromisoformat(self.end) if self.end else date.today()
        return {"next": max(self.start, (last + timedelta(1)).isoformat())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["next"] >= end["next"]:
            return []
        first = date.fromisoformat(start["next"]) - timedelta(self.overlap if start["next"] > self.start else 0)
        return self.stretches(max(first, date.fromisoformat(self.start)), date.fromisoformat(end["next"]) - timedelta(1))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gazetta_feed"

    def schema(self) -> str:
        return "feed string, first date, last date, page int, body string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def read_live(spark: SparkSession, feed: str, start: date, end: date, timeout: int = 30) -> DataFrame:
    """feed, page and body of a feed for a closed range of dates, asked for as one."""
    register(spark)
    days = (end - start).days + 1  # the listing's own pages follow each other over the whole range
    return spark.read.format("gazetta_feed").option("feed", feed).option("from", str(start)).option("to", str(end)).option("timeout", timeout).option("days", max(1, days)).load().select("feed", "page", "body")


def detail_pages(rows: DataFrame, options: Options | None = None, get: Callable[[str], str] | None = None) -> DataFrame:
    """detail_url, html and error of the detail page of each address in rows (detail_url), tried several times with growing waits."""
    own = options or Options()

    def load(url: str) -> str:
        return fetch(url, referer=f"{html_feed.BASE}/", timeout=own.detail_timeout_seconds, errors="ignore")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url in frame["detail_url"]:
                try:
                    out.append((url, with_retries(lambda url=url: (get or load)(url), own.detail_retries, own.detail_backoff_seconds), None))
                except Exception as e:  # what a page raises belongs to its item
                    out.append((url, None, str(e)))
            yield pd.DataFrame(out, columns=["detail_url", "html", "error"])

    return rows.select("detail_url").distinct().mapInPandas(run, "detail_url string, html string, error string")


def downloads(found: DataFrame, get: Callable[[str], bytes] = content_of) -> DataFrame:
    """source, circular_id, content and error of the file of each item in found that was parsed; without an address a text that says so."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                content = error = None
                try:
                    content = get(row.pdf_url) if row.pdf_url else None
                except Exception as e:  # what a file raises belongs to its item
                    error = str(e)
                out.append((row.source, row.circular_id, row.pdf_url, row.url, content, error))
            yield pd.DataFrame(out, columns=["source", "circular_id", "pdf_url", "url", "content", "error"])

    own = found.where("error_message IS NULL").select("source", "circular_id", F.coalesce("pdf_url", F.lit("")).alias("pdf_url"), "url").dropDuplicates(["source", "circular_id"])
    got = own.mapInPandas(run, "source string, circular_id string, pdf_url string, url string, content binary, error string")
    return got.select("source", "circular_id", content_or_placeholder("pdf_url", F.col("content"), F.col("circular_id"), "url").alias("content"), "error")
