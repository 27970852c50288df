"""Spark session defaults and the shared checkpoint folder.

Everything else in the package takes a ``SparkSession`` from the caller; this
module only exists so tests, the bench and the driver entry start Spark the
same way.  On a cluster the session is built by the platform and only
``ensure_checkpoint_dir`` matters: it reads ``spark.checkpoint.dir`` from the
session and sets a local folder only when nothing is configured (tests).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
FREE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings that matter for every job in the package.  Shuffle partitions are
# sized per run by the caller (8 locally; on a 1000-executor cluster AQE
# coalesces from a large initial number such as 20000).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # checkpoint files of dropped DataFrames are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # RocksDB keeps unbounded per-key state (voters, codes) off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = "local[8]", app: str = "civiccases",
              shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    A cluster names a shared folder (HDFS/S3/ABFS) in ``spark.checkpoint.dir``;
    we never replace it, and refuse to go on without one: executors would write
    to their own disks.  Local runs without it get a fresh folder under /tmp.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="civiccases-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (for written intermediate tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a command's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_CONF, None)
    spark.conf.set(FREE_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_CONF)
        else:
            spark.conf.set(FREE_CONF, before)
