"""Ingestion and indexing of a store: one pass, or micro-batches that call it."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.operators import assets as A
from gazetta.operators import index as X
from gazetta.operators import state as S
from gazetta.operators.segments import Index
from gazetta.options import Options
from gazetta.schemas import CHUNKS
from gazetta.session import fresh_path, removed, ship
from gazetta.sources.assets import Extractor, contents, expanded, land, plain_pages, texts
from gazetta.sources.live import content_of, downloads
from gazetta.sources.registry import Source
from gazetta.store import Store

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Ingested:
    version: int
    counters: list
    rejected: int


def ingest(store: Store, detected: DataFrame, downloads: DataFrame, today: date, now: Column, options: Options | None = None, batch: int | None = None) -> Ingested:
    """Merges detected items (with pos), fetches what isn't yet, and moves checkpoints.

    downloads: source, circular_id, content and error of what was loaded; an item
    with neither is a failure.
    """
    options = options or Options()
    ship(store.spark)
    base = store.version()
    # ids of the whole state are compared, then only the buckets that the batch goes to are read and written
    own, rejected = S.targeted(store.table("circulars"), detected)
    own, rejected = own.persist(), rejected.persist()
    touched = store.touched(own.select("id"))
    before, old_assets, checkpoints = store.table("circulars", touched), store.table("circular_assets", touched), store.table("scraper_checkpoints")
    merged = S.merged(before, own, rejected, now)
    decided = S.fetch_decision(merged.state, before, merged.applied, options.refetch_on_url_change).persist()
    todo = decided.where("NOT skip")
    loaded = todo.where("error_message IS NULL").join(downloads.select("source", "circular_id", "content", F.col("error").alias("load_error")), ["source", "circular_id"], "left")
    ready = loaded.where("content IS NOT NULL").select(F.col("id").alias("circular_id"), "source", F.col("circular_id").alias("public_id"), "issue_date", "pdf_url", "content")
    got = expanded(ready, options.storage_path).persist()
    land(got, options.storage_path)
    fine = got.where("error IS NULL")
    main = fine.where("asset_role != 'extracted_pdf'").select(F.col("circular_id").alias("id"), F.lit(None).cast("string").alias("error"), "file_path", "content_hash")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    broken = got.where("error IS NOT NULL").select(F.col("circular_id").alias("id"), "error", *none("file_path", "content_hash"))
    missing = loaded.where("content IS NULL").select("id", F.coalesce("load_error", F.lit("no content")).alias("error"), *none("file_path", "content_hash"))
    unparsed = todo.where("error_message IS NOT NULL").select("id", S.failed_message("error_message").alias("error"), *none("file_path", "content_hash"))
    outcomes = main.unionByName(broken).unionByName(missing).unionByName(unparsed)
    state = S.with_outcomes(merged.state, outcomes, now)
    new_assets = A.replaced(old_assets, fine.drop("content", "error"), main.select("id"), now)
    counters = S.run_counters(decided, outcomes)
    marks = S.next_checkpoints(checkpoints, counters, F.lit(today), options.lookback_days, now)
    told, lost = counters.collect(), merged.rejected.count()  # a row for each source
    version = store.publish({"circulars": state, "circular_assets": new_assets, "scraper_checkpoints": marks}, batch, touched, base=base)
    for row in told:
        log.info("source %s: %s", row["source"], row.asDict())
    for df in (own, rejected, decided, got):
        df.unpersist()
    return Ingested(version, told, lost)


def index(store: Store, now: Column, options: Options | None = None, extractor: Extractor = plain_pages, record_id: str | None = None) -> tuple[int, int]:
    """Indexes pending records, those tried least first, the oldest of them, or one record anew with what is stale removed; gives how many went well and not.

    What can't be indexed stays pending with its reason in index_attempts. Nothing
    counts as indexed unless all chunks of the batch are stored.
    """
    options = options or Options()
    ship(store.spark)
    base = store.version()
    state = store.table("circulars")
    wanted = state.where(F.col("id") == record_id) if record_id else S.pending(state, options.batch_size, store.table("index_attempts"))
    wanted = [r[0] for r in wanted.select("id").collect()]  # a batch
    if record_id and not wanted:
        raise ValueError(f"no record {record_id}")
    ids = store.spark.createDataFrame([(x,) for x in wanted], "id string")
    touched = store.touched(ids)
    state, attempts = store.table("circulars", touched), store.table("index_attempts", touched)
    assets = A.backfilled(store.table("circular_assets", touched), state, now)
    records = state.join(F.broadcast(ids), "id", "left_semi").persist()
    own = A.indexable(assets.join(F.broadcast(ids.withColumnRenamed("id", "circular_id")), "circular_id", "left_semi").select(assets.columns)).persist()
    read = contents(own).persist()  # what has no file is told in index_attempts
    there = own.join(read.select(F.col("asset_id").alias("id")), "id", "left_semi").select(own.columns)
    path = fresh_path(store.spark, "chunks")
    X.upserted(store.spark.createDataFrame([], CHUNKS), X.documents(records, there, texts(read, extractor), now, options.chunk_size, options.chunk_overlap)).write.parquet(path)
    new = store.spark.read.schema(CHUNKS).parquet(path)
    told = X.index_outcomes(records, new, there).persist()
    done = told.where("ok").select("id")
    out = X.batch_counts(told).first()
    index_ = store.index().updated(new, store.index_path, done if record_id else None)
    if not X.upsert_counts(new, index_.of_records(done)).first()["complete"]:
        raise RuntimeError("not all chunks of the batch are stored; its records stay pending")
    state = S.mark_indexed(state, told.where("ok").select("id", "n"), options.index_name, now)
    store.publish({"circular_assets": assets, "circulars": state, "index_attempts": S.attempted(attempts, told, now)}, touched=touched, index=index_, base=base)
    removed(store.spark, path)
    for df in (records, own, read, told):
        df.unpersist()
    return out["processed"], out["failed"]


def reset(store: Store, index_state: bool = False, bloom: bool = False, chunks: bool = False) -> int:
    """Clears the index state of all records, the checkpoints' bloom columns, the chunks."""
    tables = {}
    if index_state:
        tables["circulars"] = S.clear_index_state(store.table("circulars"))
    if bloom:
        tables["scraper_checkpoints"] = S.reset_bloom(store.table("scraper_checkpoints"))
    return store.publish(tables, index=Index(store.spark, CHUNKS) if chunks else None)


def run(store: Store, sources: list[Source], today: date, now: Column, options: Options | None = None, get: Callable[[str], bytes] = content_of) -> dict[str, Ingested]:
    """Ingests one source after another, each from its checkpoint on; what failed in a source is told and doesn't keep the others from running.

    What a source gives is written once before it is used, since reading it again
    would ask the site again.
    """
    options, out = options or Options(), {}
    ship(store.spark)
    for source in sources:
        known = store.table("scraper_checkpoints").where(F.col("source") == source.name).select("last_run_date").first()
        start = known[0] if known and known[0] else today - timedelta(days=options.lookback_days)
        paths = [fresh_path(store.spark, f"{source.name}-{x}") for x in ("items", "files")]
        try:
            source.detect(store.spark, start, today, now).write.parquet(paths[0])
            found = store.spark.read.parquet(paths[0])
            downloads(found, get).write.parquet(paths[1])
            out[source.name] = ingest(store, found, store.spark.read.parquet(paths[1]), today, now, options)
        except Exception:
            log.exception("source %s failed", source.name)
        finally:
            for path in paths:
                removed(store.spark, path)
    return out
