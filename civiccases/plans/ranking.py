"""Global numbering without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one task
(``Exchange SinglePartition``).  Instead:

1. bucket every row by a coarse, order-preserving prefix of the sort key
   (hour of the timestamp by default) and count rows per bucket - a partial
   aggregate, so only one small row per bucket and map task is shuffled;
2. a running sum over that small table gives each bucket's offset (the only
   single-partition step, and its size is the number of buckets, bounded by
   time span / bucket width, not by the data);
3. join the offsets back (AQE broadcasts them once the count stage shows they
   are small) and ``row_number`` inside each bucket; rank = offset + local.

The rank depends on data only (the order must be total), not on physical
partitioning, so it is stable under AQE coalescing and task retries.  A bucket
that holds a large share of all rows is cut into slices along the order
(``plans.slices``); a (bucket, slice) is the unit of the inner sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.plans.keys import stand_in
from civiccases.plans.slices import SLICE_ROWS, cell_counts, cuts_of, hot_cells, parts_for, slice_counts, slice_of


def bucket_of(ts: Column | str, unit: str = "hour") -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit, c)


def global_rank(df: DataFrame, bucket: Column, order: list[str], name: str = "seq",
                start: Column | int = 1, slice_rows: int = SLICE_ROWS, n_rows: int = 0) -> DataFrame:
    """Add ``name`` = dense 1-based position (+ start - 1) in ascending ``order`` (NULL first).

    ``bucket`` is a time and must be non-decreasing along ``order`` (a prefix of
    its first key); ``order`` names timestamp and numeric columns and must be total (end
    with a unique key).  ``n_rows``, where known, is about the number of rows:
    tasks then sort about as many, however many there are in all.
    """
    start_col = F.lit(start) if isinstance(start, int) else start
    b = df.withColumn("_bucket", bucket)
    # never NULL, and before all others where it was: joins on it are plain equalities
    b = b.withColumn("_bucket", F.coalesce("_bucket", stand_in(b.schema["_bucket"].dataType)))
    narrow, cell, keys = b.select("_bucket", *order), ["_bucket"], ["_ob"]
    # the counts serve both the offsets and the choice of hot buckets, from one exchange
    counts = cell_counts(narrow, cell, keys)
    cuts = cuts_of(narrow, cell, order, hot_cells(counts, keys, slice_rows), keys)
    running = Window.orderBy("_ob").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_ob", (F.sum("_rows").over(running) - F.col("_rows")).alias("_offset"))
    # rows of the slices before, inside a hot bucket; nothing without one
    before = Window.partitionBy("_ob").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = slice_counts(narrow, cell, order, cuts, keys).select(
        F.col("_ob").alias("_ib"), F.col("_slice").alias("_is"), (F.sum("_in").over(before) - F.col("_in")).alias("_within"))
    cuts = cuts.withColumnRenamed("_ob", "_cb")
    sliced = (b.join(F.broadcast(cuts), F.col("_bucket") == F.col("_cb"), "left")
              .withColumn("_slice", slice_of(order)).drop("_cb", "_cuts"))
    units = (offsets.join(inside, F.col("_ob") == F.col("_ib"), "left")
             .groupBy("_ob", F.coalesce("_is", F.lit(0).cast("long")).alias("_os"))
             .agg(F.max(F.col("_offset") + F.coalesce("_within", F.lit(0))).alias("_offset")))
    parts = parts_for(df.sparkSession, n_rows)
    if parts:  # dealt on this side, whose parts the rows then follow, so that it goes with the join where that is dropped
        units = units.repartition(parts, "_ob", "_os").hint("shuffle_hash")
    # A left join on a grouped (hence unique) key: lossless here, and Catalyst drops it when the rank is not used.
    # Its key is what the window is partitioned by, so the rows are shuffled once and a hot bucket is many tasks.
    placed = sliced.join(units, (F.col("_bucket") == F.col("_ob")) & (F.col("_slice") == F.col("_os")), "left")
    local = Window.partitionBy("_bucket", "_slice").orderBy(*order)
    rank = F.col("_offset") + F.row_number().over(local) + start_col - F.lit(1)
    return placed.withColumn(name, rank.cast("long")).drop("_bucket", "_slice", "_ob", "_os", "_offset")
