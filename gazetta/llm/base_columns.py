"""Columns of the operators' queries that SQL can tell as well, as queries of their own with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm import fertility, license_scan, mixing, secret_scan
from gazetta.llm.common import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rules of op3_fertility count."""
    return fertility.base_ruled(table(spark, sf_dir, "documents"))


_COUNTS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, string_agg(word, ' ' ORDER BY pos) OVER v AS gram, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g WHERE n = 8),
x AS (SELECT doc_id, count(DISTINCT p) AS repeated FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM r WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS doubled FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(doubled, 0) AS n_dup_lines, coalesce(repeated, 0) AS n_repeat_words FROM d LEFT JOIN x USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the phrases of op4_license_scan stand word for word."""
    found = license_scan.op4_license_scan(spark, sf_dir)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_LICENSES = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS pos FROM d),
n AS (SELECT *, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c, lead(a, 3) OVER v AS e FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, pos, CASE WHEN a = 'gnu' AND b = 'general' AND c = 'public' AND e = 'license' THEN 'gpl' WHEN a = 'apache' AND b = 'license' THEN 'apache'
  WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'mit' AND b = 'license' THEN 'mit' END AS label FROM n),
f AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels
FROM d LEFT JOIN f USING (doc_id)"""


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets of known forms op7_secret_scan finds."""
    rows = secret_scan.scanned(table(spark, sf_dir, "documents"), ["doc_id"])
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(F.col("_doc.doc_id").alias("doc_id"), *[of(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS])


_SECRETS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM d"""


def base_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents and their sources in op9_mixing."""
    return mixing.op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


_SIZES = rf"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d"""


QUERIES = {"base_counts": base_counts, "base_licenses": base_licenses, "base_secrets": base_secrets, "base_sizes": base_sizes}
ORACLE_SQL = {"base_counts": _COUNTS, "base_licenses": _LICENSES, "base_secrets": _SECRETS, "base_sizes": _SIZES}
