"""Names, keys, dates and paths as Column functions."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space by Unicode, stated because the regex engines' own classes differ.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def one_space(x: Column | str) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(_c(x), f"{WS}+", " "))


def or_else(x: Column | str, *others: Column | str) -> Column:
    """The first that is neither null nor empty after stripping."""
    return F.coalesce(*[F.nullif(strip(y), F.lit("")) for y in (x, *others)])


def or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def lookup_key(source: Column | str, circular_id: Column | str) -> Column:
    return F.struct(F.upper(_c(source)).alias("source"), F.upper(_c(circular_id)).alias("circular_id"))


def json_feed_id(department: Column | str, number: Column | str) -> Column:
    joined = F.concat(F.upper(strip(department)), strip(number))
    return F.upper(strip(F.replace(joined, F.lit("/"), F.lit(""))))


def html_feed_id(raw: Column | str) -> Column:
    return one_space(raw)


def failed_id(detail_url: Column | str) -> Column:
    """Placeholder id of an item whose detail page failed; cut before it is upper-cased."""
    path = F.coalesce(F.try_parse_url(_c(detail_url), F.lit("PATH")), F.lit(""))
    last = F.nullif(F.regexp_extract(path, r"([^/]*)/*$", 1), F.lit(""))
    return F.concat(F.lit("SEBI_PENDING::"), F.upper(F.left(F.coalesce(last, F.lit("detail")), F.lit(32))))


def item_key(source_item_key: Column | str, url: Column | str, circular_id: Column | str) -> Column:
    return or_else(source_item_key, url, circular_id)


def compact_date(x: Column | str, strict: bool = False) -> Column:
    """yyyyMMdd; a malformed one is null, or an error if strict."""
    return (F.to_date if strict else F.try_to_date)(strip(x), "yyyyMMdd")


def long_date(x: Column | str, strict: bool = False) -> Column:
    """Like Mar 5, 2026."""
    return (F.to_date if strict else F.try_to_date)(strip(x), "MMM d, yyyy")


def safe_name(x: Column | str) -> Column:
    """A name that file systems take."""
    out = strip(F.regexp_replace(_c(x), r'[<>:"/\\|?*]+', "_"))
    out = F.regexp_replace(F.regexp_replace(out, f"{WS}+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(out, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("document"))


def match_key(x: Column | str) -> Column:
    return F.regexp_replace(F.upper(_c(x)), "[^A-Z0-9]+", "")


def download_type(url: Column | str, content: Column | str) -> Column:
    """zip or pdf, by the first bytes, else by the URL's path."""
    head = F.hex(F.substring(_c(content), 1, 4))
    path = F.lower(F.coalesce(F.try_parse_url(_c(url), F.lit("PATH")), F.lit("")))
    return F.when(head == "504B0304", "zip").when(head == "25504446", "pdf").when(path.endswith(".zip"), "zip").otherwise("pdf")


def asset_folder(root: str, source: Column | str, issue_date: Column | str, circular_id: Column | str) -> Column:
    return F.concat_ws("/", F.lit(root), F.upper(_c(source)), F.date_format(_c(issue_date), "yyyy"), F.date_format(_c(issue_date), "MM"), safe_name(circular_id))


def extracted_name(position: Column | str, member: Column | str) -> Column:
    """Name of a file from an archive: its place in three digits, and its own name made safe."""
    stem = F.regexp_replace(F.regexp_extract(_c(member), r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(F.lpad(_c(position).cast("string"), 3, "0"), F.lit("_"), safe_name(stem), F.lit(".pdf"))


def chunk_key(source, circular_id, asset_role, member, file_path) -> Column:
    return F.concat_ws(":", _c(source), _c(circular_id), _c(asset_role), F.coalesce(F.nullif(_c(member), F.lit("")), _c(file_path)))


def stable_id(*parts: Column | str) -> Column:
    """A UUID-shaped id from the contents of a row, equal in every run."""
    h = F.sha1(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def source_list(x: Column | str) -> Column:
    """Names of a comma list in capitals, trimmed, each once; empty entries go, blank ones too."""
    return F.array_distinct(F.filter(F.transform(F.split(_c(x), ","), lambda y: F.upper(strip(y))), lambda y: y != ""))


def exchange_list(x: Column | str) -> Column:
    """Names of a request's comma list: empty entries go before trimming, so blank ones stay as empty."""
    return F.transform(F.filter(F.split(_c(x), ","), lambda y: y != ""), lambda y: F.upper(strip(y)))


def shown_date(x: Column | str) -> Column:
    """Like 05 Mar 2026."""
    return F.date_format(_c(x), "dd MMM yyyy")


def lakh_grouped(x: Column | str) -> Column:
    """A whole number with the last three digits, then pairs, set apart."""
    digits = F.abs(_c(x)).cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.concat(F.when(_c(x) < 0, "-").otherwise(""), F.when(F.length(digits) > 3, F.concat(head, F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits))


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """Reference resolution of RFC 3986, for which there is no built-in."""
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href, strict=True)])


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def unescaped(x: Column | str) -> Column:
    """Character references decoded; texts without one don't leave the JVM's branch."""
    return F.when(_c(x).contains("&"), _unescaped(_c(x))).otherwise(_c(x))


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """href against base; absolute and root-relative ones natively."""
    href, base = _c(href), _c(base)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    plain = ~href.contains("/.") & ~href.contains(";")
    return F.when(href.rlike("^[a-z]+://[^/?#]+") & plain, href).when(href.rlike("^/[^/]") & (root != "") & plain, F.concat(root, href)).otherwise(joined_url(base, href))


def first_query_value(url: Column | str, name: str) -> Column:
    """Decoded value of a query parameter, null where it is absent or blank."""
    value = F.try_parse_url(_c(url), F.lit("QUERY"), F.lit(name))
    return F.nullif(F.try_url_decode(value), F.lit(""))
