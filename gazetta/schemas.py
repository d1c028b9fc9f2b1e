"""Schemas of the tables that the engine keeps."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "bigint": T.LongType(), "binary": T.BinaryType()}


def _struct(columns: str) -> T.StructType:
    """Columns by name and type; unlike Spark's own parser it needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DETECTED = _struct(
    "source string, circular_id string, full_reference string, department string, title string, issue_date date, effective_date date, "
    "url string, pdf_url string, source_item_key string, error_message string, detected_at timestamp"
)
CIRCULARS = _struct(
    "id string, source string, circular_id string, source_item_key string, full_reference string, department string, title string, issue_date date, "
    "effective_date date, url string, pdf_url string, status string, file_path string, content_hash string, error_message string, detected_at timestamp, "
    "created_at timestamp, updated_at timestamp, es_indexed_at timestamp, es_chunk_count int, es_index_name string"
)
ASSETS = _struct(
    "id string, circular_id string, asset_role string, file_path string, content_hash string, mime_type string, archive_member_path string, "
    "file_size_bytes bigint, created_at timestamp, updated_at timestamp"
)
CHECKPOINTS = _struct("source string, last_run_date date, updated_at timestamp, es_bloom_filter binary, es_last_run_at timestamp, es_records_processed int")
CHUNKS = _struct(
    "chunk_id string, circular_db_id string, circular_id string, asset_id string, asset_role string, source string, title string, department string, "
    "issue_date date, effective_date date, full_reference string, url string, pdf_url string, file_path string, archive_member_path string, "
    "content_hash string, chunk_index int, chunk_text string, indexed_at timestamp"
)
ATTEMPTS = _struct("id string, attempts int, skipped_reason string, attempted_at timestamp")
TABLES = {"circulars": CIRCULARS, "circular_assets": ASSETS, "scraper_checkpoints": CHECKPOINTS, "chunks": CHUNKS, "index_attempts": ATTEMPTS}


def ddl() -> str:
    """CREATE TABLE statements of all tables."""
    return "\n".join(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'{f.name} {f.dataType.simpleString().upper()}' for f in schema)}) USING parquet;" for name, schema in TABLES.items()) + "\n"


def export_ddl(path: str | Path) -> Path:
    """Writes the statements to a file, making its folders."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(ddl(), encoding="utf-8")
    return path
