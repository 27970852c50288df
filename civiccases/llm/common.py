"""Helpers shared by the training-data operators: tables, shared storage, Arrow batches, words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiccases.session import ensure_checkpoint_dir

#: rows of one Arrow batch handed to Python; bounds a worker's memory when texts are long
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application (Spark distributes the file)."""
    context = spark.sparkContext
    if getattr(context, "_civiccases_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="civiccases-"), "civiccases_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._civiccases_shipped = True


def python_workers(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Before a step in Python: ship the package; keep Arrow batches of whole texts small enough for a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing the
    steps before.  Every call takes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_text(col: str | Column) -> Column:
    """The text with null taken as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_array(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, width: int = 5) -> Column:
    """64-bit hashes of all runs of ``width`` words, in text order, repeats kept.

    Fewer words give one hash of the whole sequence, no word an empty array.
    Words are hashed once; a shingle hashes its words' hashes.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)

    def shingles(wh: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(wh) - width),
            lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(width)]))

    whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
    # a one-element transform binds the hashed words once
    long = F.get(F.transform(F.array(hashed), shingles), F.lit(0))
    return (F.when(n >= width, long).when(n > 0, whole)
            .otherwise(F.array().cast("array<bigint>")))
