"""Command line: `python -m gazetta.cli --store STORE run|ingest|index|search|record ...`."""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions.normalize import safe_name
from gazetta.functions.serialize import bodies
from gazetta.operators.details import detail
from gazetta.operators.search import response
from gazetta.operators.segments import top
from gazetta.options import Options, configure_logging, parse_sources
from gazetta.plans.ingest import index, ingest, reset, run
from gazetta.schemas import export_ddl
from gazetta.session import ship
from gazetta.sources import html_feed, json_feed
from gazetta.sources.assets import files
from gazetta.sources.registry import SOURCES
from gazetta.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gazetta")
    p.add_argument("--store", required=True)
    p.add_argument("--log-level", default="INFO")
    sub = p.add_subparsers(dest="command", required=True)
    live = sub.add_parser("run", help="asks the sources themselves")
    live.add_argument("--sources", type=parse_sources, default=())
    run = sub.add_parser("ingest", help="takes what has landed")
    run.add_argument("--sources", type=lambda x: parse_sources(x, distinct=False), default=())
    run.add_argument("--feed", choices=("json", "html"), default="json")
    run.add_argument("--landed", required=True, help="folder of landed JSON payloads, or of listing pages page-N.html")
    run.add_argument("--details", help="of the HTML feed: JSON lines of detail_url, html and error")
    run.add_argument("--dates", default="0001-01-01,9999-12-31", help="of the HTML feed: closed range of dates")
    run.add_argument("--files", required=True, help="folder of loaded files, named by circular id made safe")
    ix = sub.add_parser("index")
    ix.add_argument("--batch-size", type=int, default=50)
    ix.add_argument("--record-id")
    for flag in ("--setup-index", "--delete-index", "--reset-db", "--reset-bloom"):
        ix.add_argument(flag, action="store_true")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--sources", type=parse_sources, default=None)
    find.add_argument("--size", type=int, default=Options().search_size)
    find.add_argument("--escape", action="store_true", help="previews as HTML text")
    one = sub.add_parser("record")
    one.add_argument("id")
    schema = sub.add_parser("schema")
    schema.add_argument("path")
    return p


def landed(spark: SparkSession, args: argparse.Namespace, now: Column) -> DataFrame:
    """Detected items of the files that have landed."""
    if args.feed == "json":
        return json_feed.detected(json_feed.landed(spark, args.landed), now)
    pages = json_feed.landed(spark, args.landed).select(F.lit("run").alias("run"), F.regexp_extract("file", r"(\d+)\.html$", 1).cast("int").alias("page"), F.col("payload").alias("html"))
    start, end = (F.lit(x.strip()).cast("date") for x in args.dates.split(","))
    rows = html_feed.listing_rows(html_feed.read_pages(pages), start, end)
    details = spark.read.schema("detail_url string, html string, error string").json(args.details or [])
    return html_feed.detected(rows, details, now).drop("run")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    configure_logging(args.log_level)
    if args.command == "schema":
        export_ddl(args.path)
        return 0
    spark = SparkSession.builder.appName("gazetta").getOrCreate()
    ship(spark)
    store, now = Store(spark, args.store), F.current_timestamp()
    if args.command == "run":
        wanted = SOURCES.enabled(args.sources)
        return int(len(run(store, wanted, date.today(), now, Options.from_env())) < len(wanted))
    if args.command == "ingest":
        found = landed(spark, args, now)
        found = found.where(F.col("source").isin(list(args.sources))) if args.sources else found
        loaded = files(spark, args.files).select(F.regexp_extract("file_path", r"([^/]+)\.[^./]+$", 1).alias("name"), "content")
        loaded = found.select("source", "circular_id", safe_name("circular_id").alias("name")).distinct().join(loaded, "name").select("source", "circular_id", "content", F.lit(None).cast("string").alias("error"))
        ingest(store, found, loaded, date.today(), now, Options.from_env())
    elif args.command == "index":
        if args.setup_index:
            store.ensure()
            return 0
        if args.delete_index or args.reset_db or args.reset_bloom:
            reset(store, index_state=args.reset_db, bloom=args.reset_bloom, chunks=args.delete_index)
            return 0
        _, failed = index(store, now, replace(Options.from_env(), batch_size=args.batch_size), record_id=args.record_id)
        return int(bool(args.record_id and failed))
    elif args.command == "record":
        found = bodies(detail(store.table("circulars"), store.table("circular_assets"), args.id), F.lit(args.id).alias("id"), "circular", "assets").collect()  # one row or none
        for row in found:
            print(row["body"])
        return int(not found)
    else:
        found = top(store.index(), args.query, {"source": list(args.sources) if args.sources is not None else None}, args.size)
        for row in response(found.hits, args.query, args.escape).toJSON().collect():  # args.size at most
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
