"""Asset files: reading, expanding archives, extracting text, and landing."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.functions.normalize import asset_folder, download_type, extracted_name
from gazetta.operators.assets import chosen_members
from gazetta.sources.sink import FileSink

#: Takes a file's bytes and gives the text of each page.
Extractor = Callable[[bytes], list[str | None]]


def files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, file_size_bytes and content of each file under a path."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.select(F.regexp_replace("path", "^file:", "").alias("file_path"), F.col("length").alias("file_size_bytes"), "content")


def qualified(spark: SparkSession, path: Column | str) -> Column:
    """A path as Spark's readers name it, whatever it was written as: with its file system, and without a scheme under the default one's working folder."""
    path = F.col(path) if isinstance(path, str) else path
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    root, here = (fs.makeQualified(p).toString().rstrip("/") for p in (spark._jvm.org.apache.hadoop.fs.Path("/"), fs.getWorkingDirectory()))
    named = F.regexp_replace(path, "^file:/+", "file:/")
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), named).when(path.startswith("/"), F.concat(F.lit(root), path)).otherwise(F.concat(F.lit(f"{here}/"), path))


def contents(assets: DataFrame) -> DataFrame:
    """asset_id and content of the assets (id, file_path) whose file is there; no other file is read.

    For a batch: the paths of its assets are told to the driver, which looks their
    folders up.
    """
    spark = assets.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = assets.select(F.col("id").alias("asset_id"), qualified(spark, "file_path").alias("path")).where("path IS NOT NULL").persist()
    wanted = {r[0] for r in own.select("path").distinct().collect()}
    there = []
    for folder in sorted({p.rpartition("/")[0] for p in wanted}):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(conf)
        there += [p for p in (str(x.getPath().toString()) for x in (fs.listStatus(at) if fs.exists(at) else ()) if x.isFile()) if p in wanted]
    if not there:
        return own.select("asset_id", F.lit(None).cast("binary").alias("content")).limit(0)
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in there]  # readers take paths as patterns
    loaded = spark.read.format("binaryFile").load(literal).select("path", "content")
    return own.join(loaded, "path").select("asset_id", "content")


def path_parts(path: Column | str) -> dict[str, Column]:
    """Source, year, month and circular of an asset's path."""
    pattern = r"([^/]+)/(\d{4})/(\d{2})/([^/]+)/(?:original|extracted)/[^/]+$"
    return {name: F.regexp_extract(path, pattern, k) for k, name in enumerate(("source", "year", "month", "circular"), 1)}


def content_or_placeholder(url: Column | str, content: Column | str, circular_id: Column | str, page: Column | str) -> Column:
    """Bytes as loaded; where there is no address, a text that says so, with the item's page."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pending = F.concat(F.lit("PDF download pending for "), circular_id, F.lit("\nSource URL: "), F.coalesce(F.col(page) if isinstance(page, str) else page, F.lit("")), F.lit("\n"))
    return F.when(url == "", pending.cast("binary")).otherwise(content)


def members(archives: DataFrame) -> DataFrame:
    """archive, source, circular_id, member, position, content and error of each file in archives (archive, source, circular_id, content).

    Archives that can't be read, and those without a PDF, have one row with an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(row.content)) as z:
                        own = [x for x in z.infolist() if not x.is_dir() and x.filename.lower().endswith(".pdf")]
                        out = [(row.archive, row.source, row.circular_id, x.filename, k, z.read(x), None) for k, x in enumerate(own, 1)]
                    error = None if out else f"ZIP archive contains no PDFs: {row.archive}"
                except (zipfile.BadZipFile, RuntimeError, OSError) as e:
                    out, error = [], str(e)
                out = out or [(row.archive, row.source, row.circular_id, None, None, None, error)]
                yield pd.DataFrame(out, columns=["archive", "source", "circular_id", "member", "position", "content", "error"])

    schema = "archive string, source string, circular_id string, member string, position int, content binary, error string"
    return archives.select("archive", "source", "circular_id", "content").mapInPandas(run, schema)


def expanded(downloads: DataFrame, root: str) -> DataFrame:
    """Assets of downloads (circular_id: the record's id, source, public_id, issue_date, pdf_url, content): the original, and the PDFs of an archive.

    The hash of what is in an archive is the archive's. `content` holds the bytes to land.
    """
    own = downloads.withColumn("kind", download_type("pdf_url", "content")).withColumn("folder", asset_folder(root, "source", "issue_date", "public_id")).withColumn("content_hash", F.sha2("content", 256))
    zipped = F.col("kind") == "zip"
    original = own.select(
        "circular_id", F.when(zipped, "original_zip").otherwise("original_pdf").alias("asset_role"), F.concat("folder", F.when(zipped, "/original/source.zip").otherwise("/original/source.pdf")).alias("file_path"),
        "content_hash", F.when(zipped, "application/zip").otherwise("application/pdf").alias("mime_type"), F.lit(None).cast("string").alias("archive_member_path"), F.length("content").cast("bigint").alias("file_size_bytes"), "content", F.lit(None).cast("string").alias("error"),
    )
    archives = own.where(zipped)
    found = members(archives.select(F.col("circular_id").alias("archive"), "source", F.col("public_id").alias("circular_id"), "content"))
    picked = chosen_members(found.where("member IS NOT NULL").select("archive", "source", "circular_id", "member", "position", "content"))
    # numbers of the picked ones, in the archive's order
    at = picked.groupBy("archive").agg(F.array_sort(F.collect_list("position")).alias("all"))
    own_folder = archives.select(F.col("circular_id").alias("archive"), "folder", "content_hash")
    picked = picked.join(at, "archive").join(own_folder, "archive").withColumn("k", F.array_position("all", F.col("position")))
    inner = picked.select(
        F.col("archive").alias("circular_id"), F.lit("extracted_pdf").alias("asset_role"), F.concat("folder", F.lit("/extracted/"), extracted_name("k", "member")).alias("file_path"),
        "content_hash", F.lit("application/pdf").alias("mime_type"), F.col("member").alias("archive_member_path"), F.length("content").cast("bigint").alias("file_size_bytes"), "content", F.lit(None).cast("string").alias("error"),
    )
    broken = found.where("error IS NOT NULL").select(F.col("archive").alias("circular_id"), *[F.lit(None).cast(original.schema[c].dataType).alias(c) for c in original.columns[1:-1]], "error")
    return original.join(broken.select("circular_id"), "circular_id", "left_anti").unionByName(inner).unionByName(broken)


def circular_folder(path: Column | str) -> Column:
    """The folder of a circular, from the path of one of its files."""
    return F.regexp_extract(path, r"^(.*)/(?:original|extracted)/[^/]+$", 1)


def land(assets: DataFrame, staging: str | None = None) -> None:
    """Writes the bytes of assets to their paths, where they take the place of what is in the folders of their circulars.

    A circular's files are written by one task to a staged folder, and staged folders
    take the place of the old ones when all tasks have ended well; if one fails for
    good, the old files stay and what was staged goes. staging: a folder of the same
    file system to stage them in, else each is staged beside its place.
    """
    spark = assets.sparkSession
    spark.dataSource.register(FileSink)
    own = assets.where("file_path IS NOT NULL AND content IS NOT NULL").select(qualified(spark, "file_path").alias("path"), "content")
    own = own.select(circular_folder("path").alias("folder"), F.substring_index("path", "/", -2).alias("name"), "content").where("folder != ''")
    options = {} if staging is None else {"staging": spark.range(1).select(qualified(spark, F.lit(staging))).first()[0]}
    own.repartition("folder").write.format(FileSink.name()).options(**options).mode("append").save()


def plain_pages(content: bytes) -> list[str]:
    """Extractor for text files: form feeds end pages."""
    return content.decode("utf-8", "replace").split("\f")


def texts(assets: DataFrame, extractor: Extractor = plain_pages) -> DataFrame:
    """asset_id, text and error of each asset (asset_id, content): its pages by line, stripped. Null content is a missing file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, content in zip(frame["asset_id"], frame["content"], strict=True):
                try:
                    if content is None:
                        raise FileNotFoundError("file not found")
                    out.append((key, "\n".join(p or "" for p in extractor(bytes(content))).strip(), None))
                except Exception as e:  # what an extractor raises belongs to its asset
                    out.append((key, None, str(e)))
            yield pd.DataFrame(out, columns=["asset_id", "text", "error"])

    return assets.select("asset_id", "content").mapInPandas(run, "asset_id string, text string, error string")
