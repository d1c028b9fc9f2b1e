"""The circulars' state as functions from a state and a batch to the next state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.normalize import item_key, or_empty, stable_id

#: Columns that a batch overwrites in a row that it matches.
OVERWRITTEN = ("circular_id", "source_item_key", "full_reference", "department", "title", "issue_date", "effective_date", "url", "pdf_url", "detected_at")
INDEX_STATE = {"es_indexed_at": "timestamp", "es_chunk_count": "int", "es_index_name": "string"}


@dataclass(frozen=True)
class Merged:
    """The next state, the rows of the batch with the id they went to, and those whose ids belong to two rows."""

    state: DataFrame
    applied: DataFrame
    rejected: DataFrame


def matched(state: DataFrame, batch: DataFrame) -> DataFrame:
    """batch with by_key and by_id: ids of the rows with its source and item key, and with its source and circular id.

    Two equi-joins in place of one with OR, which would compare all pairs.
    """
    batch = batch.withColumn("source_item_key", item_key("source_item_key", "url", "circular_id"))
    keys = state.where("source_item_key IS NOT NULL").groupBy("source", "source_item_key").agg(F.min("id").alias("by_key"))
    ids = state.groupBy("source", "circular_id").agg(F.min("id").alias("by_id"))
    return batch.join(keys, ["source", "source_item_key"], "left").join(ids, ["source", "circular_id"], "left")


def targeted(state: DataFrame, batch: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The items of batch with the id of the row they go to and whether it is new, and those whose two matches are different rows.

    Of state it reads the columns of the keys only.
    """
    own = matched(state, batch)
    clash = F.col("by_key").isNotNull() & F.col("by_id").isNotNull() & (F.col("by_key") != F.col("by_id"))
    rejected = own.where(clash)
    own = own.where(~clash)
    # new items with one circular id fall together, as each after the first finds the one before
    first = own.groupBy("source", "circular_id").agg(F.min_by("source_item_key", order).alias("first_key"))
    own = own.join(first, ["source", "circular_id"])
    own = own.withColumn("id", F.coalesce("by_key", "by_id", stable_id("source", "first_key"))).withColumn("inserted", F.coalesce("by_key", "by_id").isNull())
    return own.drop("by_key", "by_id", "first_key"), rejected


def merge(state: DataFrame, batch: DataFrame, now: Column, order: str = "pos") -> Merged:
    """Upsert of detected items: a match by item key counts before one by circular id; of several items for one row the last counts, by order.

    Of items with one order the one with the largest source_item_key is last.
    """
    own, rejected = targeted(state, batch, order)
    return merged(state, own, rejected, now, order)


def merged(state: DataFrame, own: DataFrame, rejected: DataFrame, now: Column, order: str = "pos") -> Merged:
    """merge for targeted items; state may be any part that holds all rows with the ids of own."""
    columns = [c for c in own.columns if c != "id"]
    last = own.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(order, "source_item_key")).alias("r"), F.count("*").alias("items")).select("id", "r.*", "items")
    news = last.select(F.col("id"), F.lit(True).alias("_hit"), F.col("source").alias("_new_source"), *[F.col(c).alias(f"_new_{c}") for c in OVERWRITTEN])
    both = state.join(news, "id", "full_outer")
    hit, fresh = F.col("_hit").isNotNull(), F.col("status").isNull()
    fixed = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in OVERWRITTEN}
    fixed |= {"source": F.coalesce("source", "_new_source"), "status": F.coalesce("status", F.lit("DISCOVERED")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "created_at": F.when(hit & fresh, now).otherwise(F.col("created_at"))}
    return Merged(both.select(*[fixed.get(c, F.col(c)).alias(c) for c in state.columns]), last, rejected)


def fetch_decision(state: DataFrame, before: DataFrame, applied: DataFrame, refetch_on_url_change: bool = False) -> DataFrame:
    """applied items with skip: those whose row was fetched before; with refetch_on_url_change only if the address is as before."""
    was = before.select("id", F.col("status").alias("_status"), F.col("pdf_url").alias("_url"))
    skip = F.coalesce(F.col("_status") == "FETCHED", F.lit(False))
    skip = skip & F.col("_url").eqNullSafe(F.col("pdf_url")) if refetch_on_url_change else skip
    return applied.join(was, "id", "left").withColumn("skip", skip & F.col("error_message").isNull()).drop("_status", "_url")


def with_outcomes(state: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Status, error and file of each row with an outcome (id, error, file_path, content_hash): fetched without an error, else failed."""
    own = outcomes.select("id", F.lit(True).alias("_hit"), F.col("error").alias("_error"), F.col("file_path").alias("_path"), F.col("content_hash").alias("_hash"))
    hit = F.col("_hit").isNotNull()
    fine = hit & F.col("_error").isNull()
    fixed = {
        "status": F.when(fine, "FETCHED").when(hit, "FAILED").otherwise(F.col("status")),
        "error_message": F.when(hit, F.col("_error")).otherwise(F.col("error_message")),
        "file_path": F.when(fine, F.col("_path")).otherwise(F.col("file_path")),
        "content_hash": F.when(fine, F.col("_hash")).otherwise(F.col("content_hash")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return state.join(own, "id", "left").select(*[fixed.get(c, F.col(c)).alias(c) for c in state.columns])


def update_status(state: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Status and error of the rows in updates (id, status, error); a null error clears the old one."""
    own = updates.select("id", F.col("status").alias("_status"), F.col("error").alias("_error"))
    hit = F.col("_status").isNotNull()
    fixed = {"status": F.coalesce("_status", "status"), "error_message": F.when(hit, F.col("_error")).otherwise(F.col("error_message")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return state.join(own, "id", "left").select(*[fixed.get(c, F.col(c)).alias(c) for c in state.columns])


def update_files(state: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """File and hash of the rows in updates (id, file_path, content_hash)."""
    own = updates.select("id", F.col("file_path").alias("_path"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    fixed = {"file_path": F.when(hit, F.col("_path")).otherwise(F.col("file_path")), "content_hash": F.when(hit, F.col("_hash")).otherwise(F.col("content_hash")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return state.join(own, "id", "left").select(*[fixed.get(c, F.col(c)).alias(c) for c in state.columns])


def failed_message(error: Column | str) -> Column:
    return F.coalesce(F.nullif(F.col(error) if isinstance(error, str) else error, F.lit("")), F.lit("Source detail parsing failed"))


def next_checkpoints(checkpoints: DataFrame, runs: DataFrame, today: Column, lookback_days: int, now: Column) -> DataFrame:
    """Checkpoints after runs (source, failed count, first_failed date).

    Today where nothing failed; the day before the first failure where that is
    ahead of the last checkpoint; else the last one.
    """
    own = runs.join(checkpoints.select("source", F.col("last_run_date").alias("_last")), "source", "left")
    last = F.coalesce("_last", F.date_sub(today, lookback_days))
    safe = F.date_sub("first_failed", 1)
    new = F.when(F.col("failed") == 0, today).when(F.col("first_failed").isNull(), last).when(safe > last, safe).otherwise(last)
    return set_checkpoints(checkpoints, own.select("source", new.alias("run_date")), now)


def set_checkpoints(checkpoints: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Checkpoints with the dates of runs (source, run_date), in new rows or old ones."""
    own = runs.select("source", F.col("run_date").alias("_date"))
    hit = F.col("_date").isNotNull()
    fixed = {"last_run_date": F.coalesce("_date", "last_run_date"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "es_records_processed": F.coalesce("es_records_processed", F.lit(0))}
    return checkpoints.join(own, "source", "full_outer").select(*[fixed.get(c, F.col(c)).alias(c) for c in checkpoints.columns])


def start_dates(checkpoints: DataFrame, sources: DataFrame, today: Column, lookback_days: int) -> DataFrame:
    """source and from_date: its checkpoint, or so many days before today."""
    return sources.join(checkpoints.select("source", "last_run_date"), "source", "left").select("source", F.coalesce("last_run_date", F.date_sub(today, lookback_days)).alias("from_date"))


def run_counters(decided: DataFrame, outcomes: DataFrame) -> DataFrame:
    """detected, skipped, fetched, failed and first_failed of each source; decided has skip, outcomes has id and error."""
    own = decided.join(outcomes.select("id", F.col("error").alias("_error"), F.lit(True).alias("_hit")), "id", "left")
    failed = F.col("_error").isNotNull()
    return own.groupBy("source").agg(
        F.count("*").alias("detected"), F.count_if("skip").alias("skipped"), F.count_if(F.col("_hit").isNotNull() & ~failed).alias("fetched"),
        F.count_if(failed).alias("failed"), F.min(F.when(failed, F.col("issue_date"))).alias("first_failed"),
    )


def clear_index_state(state: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Nothing indexed, in the rows of ids (id) or in all."""
    if ids is None:
        return state.withColumns({c: F.lit(None).cast(t) for c, t in INDEX_STATE.items()}).select(state.columns)
    own = state.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    return own.withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in INDEX_STATE}).select(state.columns)


def mark_indexed(state: DataFrame, counts: DataFrame, index_name: str, now: Column) -> DataFrame:
    """Index state of the rows in counts (id, n)."""
    own = state.join(counts.select("id", F.col("n").alias("_n")), "id", "left")
    hit = F.col("_n").isNotNull()
    fixed = {"es_indexed_at": F.when(hit, now).otherwise(F.col("es_indexed_at")), "es_chunk_count": F.coalesce(F.col("_n").cast("int"), "es_chunk_count"), "es_index_name": F.when(hit, index_name).otherwise(F.col("es_index_name"))}
    return own.select(*[fixed.get(c, F.col(c)).alias(c) for c in state.columns])


def reset_bloom(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.withColumns({"es_bloom_filter": F.lit(None).cast("binary"), "es_last_run_at": F.lit(None).cast("timestamp"), "es_records_processed": F.lit(0)}).select(checkpoints.columns)


def as_records(state: DataFrame) -> DataFrame:
    """Rows as they are shown: some nulls are empty texts."""
    return state.withColumns({c: or_empty(c) for c in ("source_item_key", "department", "url", "pdf_url")})


def pending(state: DataFrame, limit: int = 100, attempts: DataFrame | None = None) -> DataFrame:
    """The oldest fetched rows that aren't indexed; with attempts (id, attempts) those that were tried less often come first, so that what can't be indexed keeps no place."""
    own = state.where("status = 'FETCHED' AND es_indexed_at IS NULL")
    if attempts is None:
        return own.orderBy("issue_date", "created_at", "id").limit(limit)
    own = own.join(attempts.select("id", F.col("attempts").alias("_tried")), "id", "left")
    return own.orderBy(F.coalesce("_tried", F.lit(0)), "issue_date", "created_at", "id").limit(limit).select(state.columns)


def attempted(attempts: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """attempts after outcomes (id, ok, skipped_reason): those that went well leave, the others count one more."""
    own = outcomes.select("id", F.col("ok").alias("_ok"), F.col("skipped_reason").alias("_reason"))
    both = attempts.join(own, "id", "full_outer").where("_ok IS NULL OR NOT _ok")
    hit = F.col("_ok").isNotNull()
    return both.select(
        "id", (F.coalesce("attempts", F.lit(0)) + F.when(hit, 1).otherwise(0)).alias("attempts"), F.when(hit, F.col("_reason")).otherwise(F.col("skipped_reason")).alias("skipped_reason"),
        F.when(hit, now).otherwise(F.col("attempted_at")).alias("attempted_at"),
    )


def issued_between(state: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows issued in the closed range of dates."""
    return state.where(F.col("issue_date").between(start, end))


def by_id(state: DataFrame, record_id: str) -> DataFrame:
    return state.where(F.col("id") == record_id)


def by_circular_id(state: DataFrame, circular_id: str, source: str | None = None) -> DataFrame:
    """Rows with a circular id, in either case, of one source or of all."""
    own = state.where(F.upper("circular_id") == circular_id.upper())
    return own if source is None else own.where(F.upper("source") == source.upper())


def exists(state: DataFrame, source: str, circular_id: str) -> bool:
    return bool(by_circular_id(state, circular_id, source).limit(1).count())


def sources_with(state: DataFrame, condition: Column) -> DataFrame:
    """source, and whether it has a row for which the condition holds."""
    return state.groupBy("source").agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("found"))


def newest(state: DataFrame) -> DataFrame:
    """The row of each source that was issued last; of several the one updated, then created last."""
    rest = [c for c in state.columns if c not in ("source", "issue_date", "updated_at", "created_at", "id")]
    last = state.groupBy("source").agg(F.max_by(F.struct(*rest, "issue_date", "updated_at", "created_at", "id"), F.struct("issue_date", "updated_at", "created_at", "id")).alias("r"))
    return last.select("source", "r.*").select(state.columns)


def source_counts(records: DataFrame, sources: list[str]) -> DataFrame:
    """Records of each named source, 0 where there is none; no names, no rows."""
    spark = records.sparkSession
    names = spark.createDataFrame([(x.upper(),) for x in dict.fromkeys(sources)], "source string")
    counts = records.select(F.upper("source").alias("source")).where(F.col("source").isin([x.upper() for x in sources])).groupBy("source").agg(F.count("*").alias("n"))
    return names.join(F.broadcast(counts), "source", "left").select("source", F.coalesce("n", F.lit(0).cast("long")).alias("n"))  # a row for each name


def total_counts(records: DataFrame, sources: list[str]) -> DataFrame:
    """Records of each named source that has any, and of all of them in a row without a source."""
    own = records.select(F.upper("source").alias("source")).where(F.col("source").isin([x.upper() for x in sources]))
    return own.rollup("source").agg(F.count("*").alias("n"))
