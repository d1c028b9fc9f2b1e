"""Rows as JSON texts: nulls are kept, dates and times are ISO."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.normalize import or_empty
from gazetta.schemas import ASSETS, CHUNKS, CIRCULARS

#: Fields that are empty texts where they are null, in records as they are shown.
SHOWN_EMPTY = ("source_item_key", "department", "url", "pdf_url")
OPTIONS = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def json_of(row: Column) -> Column:
    """A struct as JSON, with its null fields."""
    return F.to_json(row, OPTIONS)


def _fields(schema, prefix: str, empty: tuple[str, ...] = ()) -> Column:
    of = lambda name: F.col(f"{prefix}{name}")
    return F.struct(*[(or_empty(of(f.name)) if f.name in empty else of(f.name)).alias(f.name) for f in schema])


def record_json(prefix: str = "") -> Column:
    """A row of circulars as it is shown."""
    return json_of(_fields(CIRCULARS, prefix, SHOWN_EMPTY))


def asset_json(prefix: str = "") -> Column:
    return json_of(_fields(ASSETS, prefix))


def chunk_json(prefix: str = "") -> Column:
    """A chunk as it is stored in a search index; its id is a field too."""
    return json_of(_fields(CHUNKS, prefix))


def bodies(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, and body: the named columns, or all, as JSON."""
    return df.select(key, json_of(F.struct(*(columns or df.columns))).alias("body"))
