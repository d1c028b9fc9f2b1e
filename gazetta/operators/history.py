"""Version history: what a key's value was at a time, and from when to when it was the same.

Both rest on the last value before a row, found by sorting and never by a join on an
inequality. A key's rows are sorted by stretches of time, and the stretches' last
values are carried over by a table with a row for each key and stretch, so that a key
with a large share of all rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a stretch of time.
STRETCH = 86_400


def before(rows: DataFrame, keys: list[str], at: str, value: Column, name: str, ties: list[str] | None = None, after: bool = False, stretch: int = STRETCH) -> DataFrame:
    """rows with the last value that isn't null among the rows of its key before it, in the order of at and ties; after: the next one after it.

    at is a date or a timestamp. Null keys are one key; rows without a time come first.
    """
    ties = ties or []
    order = [(F.desc_nulls_last if after else F.asc_nulls_first)(c) for c in (at, *ties)]
    part = F.floor(F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62))) / (stretch * 1_000_000))
    own = rows.select("*", value.alias("_value"), part.cast("long").alias("_part"))
    near = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_near", F.last("_value", ignorenulls=True).over(near))
    best = (F.min_by if after else F.max_by)("_value", F.when(F.col("_value").isNotNull(), F.struct(F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62))), *ties)))
    ends = own.groupBy(*keys, "_part").agg(best.alias("_last"))
    far = Window.partitionBy(*keys).orderBy((F.desc if after else F.asc)("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_key_part"), F.last("_last", ignorenulls=True).over(far).alias("_far"))
    same = F.col("_part") == F.col("_key_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return own.join(ends, same).select(*rows.columns, F.coalesce("_near", "_far").alias(name))


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, ties: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """Each of rows with `version`, the row of versions of its key that was the last one at its time, which counts from `since` on; null if there is none.

    ties: columns of versions that order those of one time. Null keys and times match
    nothing.
    """
    ties = ties or []
    known = F.lit(True)
    for c in (*keys, since):
        known &= F.col(c).isNotNull()
    version = F.struct(*versions.columns)
    own = versions.where(known).select(*keys, F.col(since).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in ties] or [F.lit(0)]).alias("_tie"), version.alias("_version"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"))
    asking = rows.select(*keys, F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(own.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(own.schema["_version"].dataType).alias("_version"), F.struct(*rows.columns).alias("_row"))
    both = before(own.unionByName(asking), keys, "_at", F.col("_version"), "_found", ["_side", "_tie"], stretch=stretch)
    return both.where("_side = 1").select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_found")).alias("version"))


def intervals(changes: DataFrame, keys: list[str], at: str, values: list[str], ties: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """keys, values, valid_from and valid_to (not included; null for the last) of each stretch in which a key's values stay the same.

    Of changes of one time the last by ties counts from then on, and earlier ones of
    that time are stretches of no length.
    """
    now = F.struct(*values)
    told = before(changes, keys, at, now, "_before", ties, stretch=stretch)
    told = told.where(~F.col("_before").eqNullSafe(now) | F.col("_before").isNull()).drop("_before")
    told = before(told, keys, at, F.col(at), "valid_to", ties, after=True, stretch=stretch)
    return told.select(*keys, *values, F.col(at).alias("valid_from"), "valid_to")


def at_time(history: DataFrame, when: Column) -> DataFrame:
    """The rows of intervals that hold at a time."""
    return history.where((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))
