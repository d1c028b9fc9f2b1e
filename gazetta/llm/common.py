"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.session import fresh_path

#: Tables of at most this many narrow rows are broadcast (ids: 8 bytes a row, so
#: 8 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: White space of the word definition `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table written to the shared folder.

    Cuts the lineage: a lost executor costs the tasks that ran on it, not the
    steps before.
    """
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """What written gives, and the path of the table, to remove it when nothing will read it any more."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@functools.cache
def settled() -> None:
    """Once for each process: what its modules hold stays, so that trimmed() needn't walk over it after each of many short tasks."""
    gc.freeze()


def trimmed() -> None:
    """Gives memory that a Python worker holds for reuse back to the system: workers outlive their tasks, and hold what their largest one took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over the batches of a task, with trimmed() behind its last one."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        settled()
        try:
            yield from run(batches)
        finally:
            trimmed()

    return task


def only_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is (left_semi) or isn't (left_anti) in ids.

    ids is a written table; its rows are counted, and it is broadcast up to
    BROADCAST_ROWS only.
    """
    return df.join(sized(ids.select(key)), key, how)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of narrow rows, as the side of a join: broadcast up to so many rows, else sorted and merged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
