"""Assets of circulars: replacement, backfill, order, and which of them are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetta.functions.normalize import match_key, stable_id

ROLES = ("original_pdf", "original_zip", "extracted_pdf")


def rank(role: Column | str = "asset_role") -> Column:
    role = F.col(role) if isinstance(role, str) else role
    out = F.lit(9)
    for i, name in reversed(list(enumerate(ROLES))):
        out = F.when(role == name, i).otherwise(out)
    return out


def order() -> list[Column]:
    return [rank(), F.coalesce("archive_member_path", F.lit("")), F.col("file_path")]


def listed(assets: DataFrame) -> DataFrame:
    return assets.orderBy("circular_id", *order())


def primary(assets: DataFrame) -> DataFrame:
    """The first asset of each circular."""
    key = F.struct(rank().alias("r"), F.coalesce("archive_member_path", F.lit("")).alias("m"), F.col("file_path").alias("f"))
    return assets.groupBy("circular_id").agg(F.min_by(F.struct(*[c for c in assets.columns if c != "circular_id"]), key).alias("a")).select("circular_id", "a.*").select(assets.columns)


def with_ids(assets: DataFrame, now: Column) -> DataFrame:
    new = stable_id("circular_id", "asset_role", F.coalesce("archive_member_path", F.lit("")))
    return assets.withColumns({"id": new, "created_at": now, "updated_at": now})


def replaced(assets: DataFrame, new: DataFrame, parents: DataFrame, now: Column) -> DataFrame:
    """assets without those of the parents (id), and with the new ones."""
    kept = assets.join(parents.select(F.col("id").alias("circular_id")), "circular_id", "left_anti")
    return kept.select(assets.columns).unionByName(with_ids(new, now).select(assets.columns))


def without_parent(assets: DataFrame, circulars: DataFrame) -> DataFrame:
    """assets whose circular is there: deletion goes down from a circular to its assets."""
    return assets.join(circulars.select(F.col("id").alias("circular_id")), "circular_id", "left_semi")


def backfilled(assets: DataFrame, circulars: DataFrame, now: Column) -> DataFrame:
    """assets, and one for each circular with a file and none: as a PDF, whatever the file is."""
    bare = circulars.where("file_path IS NOT NULL").join(assets.select(F.col("circular_id").alias("id")), "id", "left_anti")
    new = bare.select(
        F.col("id").alias("circular_id"), F.lit("original_pdf").alias("asset_role"), "file_path", "content_hash", F.lit("application/pdf").alias("mime_type"),
        F.lit(None).cast("string").alias("archive_member_path"), F.lit(None).cast("bigint").alias("file_size_bytes"),
    )
    return assets.unionByName(with_ids(new, now).select(assets.columns))


def indexable(assets: DataFrame) -> DataFrame:
    """Extracted PDFs of a circular, or where there are none its original PDFs."""
    has = assets.where("asset_role = 'extracted_pdf'").select("circular_id").distinct()
    extracted = assets.where("asset_role = 'extracted_pdf'")
    return extracted.unionByName(assets.where("asset_role = 'original_pdf'").join(has, "circular_id", "left_anti").select(assets.columns))


def existing(assets: DataFrame, files: DataFrame) -> DataFrame:
    """assets whose file is in a listing (file_path)."""
    return assets.join(files.select("file_path"), "file_path", "left_semi").select(assets.columns)


def chosen_members(members: DataFrame) -> DataFrame:
    """Members (archive, source, circular_id, member) that are PDFs; of the JSON feed's archives those with the circular's id in the name, if any."""
    own = members.where(F.lower("member").endswith(".pdf"))
    stem = F.regexp_replace(F.regexp_extract("member", r"([^/]*)$", 1), r"\.[^.]*$", "")
    own = own.withColumn("hit", (F.upper("source") == "NSE") & (match_key("circular_id") != "") & F.contains(match_key(stem), match_key("circular_id")))
    some = own.where("hit").select("archive").distinct()
    return own.where("hit").unionByName(own.join(some, "archive", "left_anti").select(own.columns)).drop("hit")
