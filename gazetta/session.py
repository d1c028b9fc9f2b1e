"""Making the package importable on executors."""

from __future__ import annotations

import functools
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gazetta-')}/{ROOT.name}", "zip", ROOT.parent, ROOT.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def shipped(query):
    """The query, run after its package has been sent."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


#: Temporary folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir.

    Where it is unset, a temporary folder is set on a local master; a cluster
    must name one, since its machines share no temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="gazetta-checkpoint-"))
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of an intermediate table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
