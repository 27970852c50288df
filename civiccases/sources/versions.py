"""A table in versions: rows dealt to buckets by their key, a change rewrites only the buckets it touches.

    data/v=<version>/bucket=<b>/...   the rows of bucket b as of that version
    manifest/version=<version>/       one row a bucket: the version that last wrote it

A version is published by its manifest, written last and read only when Spark
has marked it complete; a write that dies before leaves the version before it as
it is, and writing a version again replaces it by the same rows.  Readers name
the buckets they need, so a small change reads and writes few folders.  The
manifest has one row a bucket and is the only thing that the driver reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiccases.session import freed_shuffles

BUCKETS = 1024


class Versions:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self, key: Column | str | None = None) -> Column:
        c = F.col(self.key) if key is None else F.col(key) if isinstance(key, str) else key
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets of some keys: at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in keys.select(self.bucket(column).alias("b")).distinct().collect())

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        top = self._path(f"{self.root}/manifest")
        if not self._fs.exists(top):
            return []
        names = [st.getPath().getName() for st in self._fs.listStatus(top)]
        return sorted(int(n.split("=")[1]) for n in names
                      if n.startswith("version=") and self._fs.exists(self._path(f"{self.root}/manifest/{n}/_SUCCESS")))

    def latest(self, before: int | None = None) -> int | None:
        found = [v for v in self.versions() if before is None or v < before]
        return found[-1] if found else None

    def _manifest(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, at long").parquet(f"{self.root}/manifest/version={version}")
        return {r["bucket"]: r["at"] for r in rows.collect()}

    def read(self, version: int, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets or of all; bucket folders are pruned by listing only those."""
        written = self._manifest(version)
        paths = [f"{self.root}/data/v={written[b]}/bucket={b}" for b in (sorted(written) if buckets is None else buckets) if b in written]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """Every row, as the first version; nothing happens if that version is published."""
        if version not in self.versions():
            self._write(rows, version, {})

    def publish(self, version: int, changed: DataFrame, base: int | None = None) -> None:
        """The version after ``base`` (by default the latest before it) with the rows of ``changed`` (whole rows) replaced or added."""
        base = self.latest(version) if base is None else base
        fresh = changed.select(*self.schema.names)
        old = self.read(base, self.touched(fresh, self.key))
        keys = fresh.select(F.col(self.key).alias("_new"))
        merged = old.join(keys, F.col(self.key) == F.col("_new"), "left_anti").unionByName(fresh)
        self._write(merged, version, self._manifest(base))

    def _write(self, rows: DataFrame, version: int, before: dict[int, int]) -> None:
        out = f"{self.root}/data/v={version}"
        # rebalanced by bucket: adaptive execution splits a large bucket's partition and joins small ones
        with freed_shuffles(rows.sparkSession):
            (rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
             .sortWithinPartitions("bucket", self.key)
             .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(out))
        names = [st.getPath().getName() for st in self._fs.listStatus(self._path(out))]
        now = before | {int(n.split("=")[1]): version for n in names if n.startswith("bucket=")}
        (self.spark.createDataFrame(sorted(now.items()), "bucket int, at long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}"))
