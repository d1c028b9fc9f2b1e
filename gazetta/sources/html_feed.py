"""Items of a paginated HTML feed: listing pages and detail pages in, detected items out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.normalize import absolute_url, failed_id, first_query_value, html_feed_id, long_date, strip, unescaped
from gazetta.sources.json_feed import first_of

SOURCE, BASE = "SEBI", "https://www.sebi.gov.in"
PDF_URL = f"{BASE}/legal/circulars/{{}}.pdf"
LISTING_URL = f"{BASE}/sebiweb/ajax/home/getnewslistinfo.jsp"
#: Form fields of a listing request, and the markup of rows and details.
FORM = {
    "search": "", "fromDate": "", "toDate": "", "fromYear": "", "toYear": "", "deptId": "-1", "sid": "1", "ssid": "7", "smid": "0",
    "ssidhidden": "7", "intmid": "-1", "sText": "Legal", "ssText": "Circulars", "smText": "", "doDirect": "-1",
}
ROW = r"""(?i)<tr[^>]*>\s*<td>([^<]+)</td><td><a href='([^']+)'[^>]*title="([^"]+)\""""
NUMBER = r"(?i)<span>\s*Circular No\.:\s*</span>\s*<span>([^<]+)</span>"
FRAMES = (r"(?i)<iframe[^>]+src='([^']+)'", r'(?i)<iframe[^>]+src="([^"]+)"')
NO_PARTS = "SEBI detail parse failed: missing circular number or PDF url"


def listing_form(start: date, end: date, page: int) -> dict[str, str]:
    """Form of a listing request; the first page and the following ones are asked for differently."""
    turn = {"next": "s", "nextValue": "1"} if page == 1 else {"next": "n", "nextValue": str(page - 1)}
    return FORM | {"fromDate": f"{start:%d-%m-%Y}", "toDate": f"{end:%d-%m-%Y}"} | turn


def pdf_url(circular_id: Column | str) -> Column:
    before, after = PDF_URL.split("{}")
    return F.concat(F.lit(before), circular_id, F.lit(after))


def raw_rows(markup: Column | str) -> Column:
    """Array of (date, url, title) as they stand on a listing page."""
    part = [F.regexp_extract_all(markup, F.lit(ROW), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(part[0].alias("a"), part[1].alias("b"), part[2].alias("c")), lambda x: F.struct(strip(x["a"]).alias("day"), strip(x["b"]).alias("href"), strip(x["c"]).alias("title")))


def has_next(markup: Column | str) -> Column:
    markup = F.col(markup) if isinstance(markup, str) else markup
    return markup.contains("title='Next'") | markup.contains('title="Next"')


def signature(rows: Column) -> Column:
    """First and last date and address, and the number of rows; empty of an empty page."""
    day = lambda k: F.coalesce(F.date_format(long_date(F.try_element_at(rows, F.lit(k))["day"]), "yyyy-MM-dd"), F.lit(""))
    href = lambda k: F.try_element_at(rows, F.lit(k))["href"]
    return F.when(F.size(rows) == 0, "").otherwise(F.concat_ws("|", day(1), href(1), day(-1), href(-1), F.size(rows).cast("string")))


def read_pages(pages: DataFrame, key: str = "run") -> DataFrame:
    """Listing pages (key, page, html) up to where reading stops: before a page without rows or with a signature that came before, after one without a next link."""
    own = pages.withColumn("rows", raw_rows("html"))
    own = own.select(key, "page", "rows", signature(F.col("rows")).alias("signature"), has_next("html").alias("more"))
    first = own.groupBy(key, "signature").agg(F.min("page").alias("first"))
    own = own.join(first, [key, "signature"])
    # the smallest page at which reading stops, combined before the exchange
    out = F.when((F.size("rows") == 0) | (F.col("page") > F.col("first")), F.col("page") - 1).when(~F.col("more"), F.col("page"))
    last = own.groupBy(key).agg(F.min(out).alias("last"))
    return own.join(last, key).where(F.col("last").isNull() | (F.col("page") <= F.col("last"))).select(key, "page", "rows", "signature")


def listing_rows(pages: DataFrame, start: Column, end: Column, key: str = "run") -> DataFrame:
    """Rows of the pages in the closed range of dates, the first of each address in listing order."""
    own = pages.select(key, "page", F.posexplode("rows").alias("pos", "row"))
    own = own.select(key, "page", "pos", long_date("row.day").alias("issue_date"), unescaped("row.title").alias("title"), absolute_url(F.lit(BASE), "row.href").alias("detail_url"))
    return first_of(own.where(F.col("issue_date").between(start, end)), [key, "detail_url"], ["page", "pos"])


def number(markup: Column | str) -> Column:
    return F.nullif(strip(unescaped(F.regexp_extract(markup, NUMBER, 1))), F.lit(""))


def document_url(detail_url: Column | str, markup: Column | str) -> Column:
    """The file that a detail page frames; single quotes are tried first."""
    src = F.coalesce(*[F.nullif(F.regexp_extract(markup, p, 1), F.lit("")) for p in FRAMES])
    return first_query_value(absolute_url(detail_url, strip(src)), "file")


def detected(rows: DataFrame, details: DataFrame, now: Column, key: str = "run") -> DataFrame:
    """Listing rows with their detail pages (detail_url, html, error) as detected items with pos, page and place in it; what failed has an error_message."""
    at = [c for c in ("page", "pos") if c in rows.columns]
    own = rows.join(details.select("detail_url", F.col("html").alias("detail"), F.col("error").alias("failure")), "detail_url", "left")
    own = own.withColumn("no", number("detail")).withColumn("pdf", document_url("detail_url", "detail"))
    ok = F.col("no").isNotNull() & F.col("pdf").isNotNull()
    message = F.when(F.col("detail").isNull(), F.concat(F.lit("SEBI detail fetch failed: "), F.coalesce("failure", F.lit("no page")))).when(~ok, NO_PARTS)
    good = F.coalesce(ok, F.lit(False))
    placeholder = failed_id("detail_url")
    return own.select(
        key, F.lit(SOURCE).alias("source"), F.when(good, html_feed_id("no")).otherwise(placeholder).alias("circular_id"), F.when(good, F.col("no")).otherwise(placeholder).alias("full_reference"),
        F.lit("").alias("department"), "title", "issue_date", F.lit(None).cast("date").alias("effective_date"), F.col("detail_url").alias("url"),
        F.when(good, F.col("pdf")).otherwise("").alias("pdf_url"), F.col("detail_url").alias("source_item_key"), F.when(~good, message).alias("error_message"), now.alias("detected_at"),
        (F.struct(*at) if at else F.lit(0)).alias("pos"),
    )


def counters(pages: DataFrame, start: Column, end: Column, found: DataFrame, key: str = "run") -> DataFrame:
    """duplicates (of addresses in the range) and failed items of each run, and whether it is incomplete."""
    own = pages.select(key, F.explode("rows").alias("row")).select(key, long_date("row.day").alias("d"), absolute_url(F.lit(BASE), "row.href").alias("u")).where(F.col("d").between(start, end))
    rows = own.groupBy(key).agg((F.count("*") - F.count_distinct("u")).alias("duplicates"))
    failed = found.groupBy(key).agg(F.count_if(F.col("error_message").isNotNull()).alias("failed"), F.bool_or(F.col("error_message").isNotNull()).alias("incomplete"))
    return rows.join(failed, key, "left").select(key, "duplicates", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("incomplete", F.lit(False)).alias("incomplete"))
