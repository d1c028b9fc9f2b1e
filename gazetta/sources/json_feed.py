"""Items of a JSON feed: payload texts in, detected items out."""

from __future__ import annotations

from datetime import date
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions.normalize import compact_date, json_feed_id, or_else, strip

SOURCE, BASE = "NSE", "https://www.nseindia.com"
PDF_URL = "https://nsearchives.nseindia.com/content/circulars/{}.pdf"
SUPPORTED = ("pdf", "zip")
ITEM = "data array<struct<fileExt:string,fileDept:string,circNumber:string,cirDate:string,circDisplayNo:string,sub:string,circFilelink:string>>"


def listing_url(start: date, end: date) -> str:
    return f"{BASE}/api/circulars?&" + urlencode({"fromDate": f"{start:%d-%m-%Y}", "toDate": f"{end:%d-%m-%Y}"})


def pdf_url(circular_id: Column | str) -> Column:
    before, after = PDF_URL.split("{}")
    return F.concat(F.lit(before), circular_id, F.lit(after))


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A row for each landed payload: its file and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("payload"))


def items(payloads: DataFrame, key: str = "file") -> DataFrame:
    """Each item of each payload with its place."""
    data = F.from_json("payload", ITEM)["data"]
    return payloads.select(key, F.posexplode(data).alias("pos", "item")).select(key, "pos", "item.*")


def supported(ext: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(ext) if isinstance(ext, str) else ext, F.lit(""))).isin(*SUPPORTED)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a minimum that is combined before the exchange."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(df.columns)


def detected(payloads: DataFrame, now: Column, key: str = "file", strict: bool = False) -> DataFrame:
    """Items of supported types, the first of each id in a payload, as detected rows with pos, by which they follow each other: the payload and the place in it.

    A malformed date is an error if strict, else it is told in error_message.
    """
    own = items(payloads, key).where(supported("fileExt"))
    own = own.withColumn("circular_id", json_feed_id(F.coalesce("fileDept", F.lit("")), F.coalesce("circNumber", F.lit(""))))
    own = first_of(own, [key, "circular_id"], ["pos"])
    day = compact_date("cirDate", strict)
    link = or_else("circFilelink", pdf_url("circular_id"))
    return own.select(
        F.lit(SOURCE).alias("source"), "circular_id", or_else("circDisplayNo", "circular_id").alias("full_reference"),
        F.upper(strip(F.coalesce("fileDept", F.lit("")))).alias("department"), strip(F.coalesce("sub", F.lit(""))).alias("title"), day.alias("issue_date"),
        F.lit(None).cast("date").alias("effective_date"), link.alias("url"), link.alias("pdf_url"), F.col("circular_id").alias("source_item_key"),
        F.when(day.isNull(), F.concat(F.lit("malformed date: "), F.coalesce("cirDate", F.lit("")))).alias("error_message"), now.alias("detected_at"),
        F.struct(F.col(key).alias("at"), "pos").alias("pos"),
    )


def counters(payloads: DataFrame, key: str = "file") -> DataFrame:
    """total, supported, unsupported and duplicates of each payload."""
    own = items(payloads, key).select(key, supported("fileExt").alias("ok"), json_feed_id(F.coalesce("fileDept", F.lit("")), F.coalesce("circNumber", F.lit(""))).alias("id"))
    kept = F.count_distinct(F.when(F.col("ok"), F.col("id")))
    return own.groupBy(key).agg(F.count("*").alias("total"), kept.alias("supported"), F.count_if(~F.col("ok")).alias("unsupported"), (F.count_if("ok") - kept).alias("duplicates"))
