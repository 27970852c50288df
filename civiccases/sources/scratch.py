"""Tables of a job's own: computed once, written below the shared checkpoint folder and read back from there.

The outputs of a job that read the same joined rows would each join them again,
with other columns, so that no exchange is shared.  A kept table costs its files
once; the shuffle files that made it go with the write (``freed_shuffles``), and
``drop`` removes the files as soon as nothing reads them any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from civiccases.session import freed_shuffles, scratch_path

#: files that are read a few times at most: small before fast
CODEC = "zstd"


class Scratch:
    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        """Below ``root``, where a repeated run replaces what it left, or else in a fresh folder."""
        self.spark, self.tables = spark, 0
        self.root = f"{root}/{name}" if root else scratch_path(spark, "kept", f"{name}-{uuid.uuid4().hex[:12]}")

    def keep(self, rows: DataFrame, **by: Column) -> DataFrame:
        """``rows`` as a stored table, in folders by the columns ``by``, which are added."""
        path, self.tables = f"{self.root}/{self.tables}", self.tables + 1
        rows = rows.withColumns(by) if by else rows
        with freed_shuffles(rows.sparkSession):
            out = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", CODEC)
            (out.partitionBy(*by) if by else out).parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.root)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the job's own, if it is there."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
