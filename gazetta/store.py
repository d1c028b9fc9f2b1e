"""Snapshots of tables: folders by version and hash bucket, and a log of which of them count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.operators.segments import Index
from gazetta.schemas import CHUNKS, TABLES

#: Tables that are kept by buckets of a column; a record and its assets are in buckets of one number.
BUCKETED = {"circulars": "id", "circular_assets": "circular_id", "index_attempts": "id"}


class Conflict(RuntimeError):
    """Another writer has published a version in the meantime; what was written isn't seen."""


class Store:
    """Tables under a root on any file system that Spark writes. A publish is seen whole or not at all.

    The marker of a version names the folder of each table, of bucketed tables that of
    each bucket, so a batch writes the buckets that it touches only. A new store has so
    many buckets as are given; some 200 MB of a table in each are a good size, and
    `rebucket` changes their number. Chunks are kept as the segments of an index.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The largest version whose marker is there; 0 if there is none."""
        marks = self._fs.globStatus(self._path(f"{self.root}/v=*/_PUBLISHED")) or []
        return max((int(m.getPath().getParent().getName()[2:]) for m in marks), default=0)

    def _marker(self, version: int) -> dict:
        """What the marker of a version says: buckets, tables (folders by bucket, 0 for tables without) and index."""
        if not version:
            return {"buckets": self._buckets, "tables": {}, "index": []}
        stream = self._fs.open(self._path(f"{self.root}/v={version}/_PUBLISHED"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self, path: str, text: str) -> None:
        """Makes a file that isn't there yet."""
        if self._fs.exists(self._path(path)):
            raise Conflict(f"{path} is there already")
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception as e:  # made by another in this moment
            raise Conflict(f"{path} is there already") from e
        stream.write(bytearray(text.encode()))
        stream.close()

    # ---- reading ----

    @property
    def buckets(self) -> int:
        return self._marker(self.version())["buckets"]

    def bucket(self, key: Column | str, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets or self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of keys, a column of ids: a number for each bucket at most."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0])).alias("bucket")).distinct().collect())

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the last version, of some buckets or of all; columns that it was written without are null."""
        marker = self._marker(self.version())
        if name == "chunks":
            return Index.of(self.spark, CHUNKS, marker["index"]).chunks()
        folders = marker["tables"].get(name, {})
        paths = [f"{self.root}/{at}" for b, at in folders.items() if buckets is None or int(b) in buckets or name not in BUCKETED]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def index(self) -> Index:
        """The chunk index of the last version."""
        return Index.of(self.spark, CHUNKS, self._marker(self.version())["index"])

    @property
    def index_path(self) -> str:
        return f"{self.root}/segments"

    # ---- writing ----

    def publish(self, tables: dict[str, DataFrame], batch: int | None = None, touched: list[int] | None = None, index: Index | None = None, base: int | None = None, buckets: int | None = None) -> int:
        """Writes a new version with the given tables; the others stay where they are.

        touched: of bucketed tables the rows are those of these buckets, and the other
        buckets stay. index: the segments that count from now on. A batch that was
        published is not again. base: the version that the rows were made from, by
        default the last one; a version after it is a Conflict. buckets: their new number,
        for which all bucketed tables must be given.
        """
        if batch is not None and self._fs.exists(self._path(f"{self.root}/batches/{batch}")):
            return self.version()
        base = self.version() if base is None else base
        marker, v = self._marker(base), base + 1
        marker["buckets"] = buckets or marker["buckets"]
        for name, df in tables.items():
            at = f"v={v}/{name}/{uuid.uuid4().hex}"
            if name in BUCKETED:
                own = df.withColumn("bucket", self.bucket(BUCKETED[name], marker["buckets"]))
                many = len(touched) if touched is not None else marker["buckets"]
                own.repartition(max(1, many), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{at}")
                written = {f.getPath().getName()[7:]: f"{at}/{f.getPath().getName()}" for f in self._fs.listStatus(self._path(f"{self.root}/{at}")) if f.getPath().getName().startswith("bucket=")}
                stays = {} if touched is None else {b: p for b, p in marker["tables"].get(name, {}).items() if int(b) not in touched}
                marker["tables"][name] = stays | written
            else:
                df.write.parquet(f"{self.root}/{at}")
                marker["tables"][name] = {"0": at}
        if index is not None:
            marker["index"] = index.told()
        self._claim(f"{self.root}/v={v}/_PUBLISHED", json.dumps(marker))
        if batch is not None:
            self._claim(f"{self.root}/batches/{batch}", "")
        return v

    def ensure(self) -> int:
        """A version in which every table is, empty ones where they were not; nothing is written if all are."""
        missing = set(TABLES) - {"chunks"} - set(self._marker(self.version())["tables"])
        return self.publish({name: self.spark.createDataFrame([], TABLES[name]) for name in sorted(missing)}) if missing else self.version()

    def drop(self, name: str) -> int:
        """A version in which the table is empty."""
        if name == "chunks":
            return self.publish({}, index=Index(self.spark, CHUNKS))
        return self.publish({name: self.spark.createDataFrame([], TABLES[name])})

    def rebucket(self, buckets: int) -> int:
        """A version with another number of buckets, for which bucketed tables are written anew."""
        return self.publish({name: self.table(name) for name in BUCKETED}, buckets=buckets)
