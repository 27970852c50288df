"""A per-key sequence operator (lag) that stays parallel for a hot key.

A window ``PARTITION BY key ORDER BY t`` sorts every row of a key in one
task: one complaint (or phone) holding a third of all rows would become one
straggler task.  The helper splits each busy key (one of more rows than a task
sorts without a cut) by a coarse, order-preserving time bucket and runs the
window per (key, bucket); what crosses a bucket edge (the last value) is carried
in from a small per-(key, bucket) table whose own window runs over one row per
bucket.  A (key, bucket) that holds a large share of all rows is cut further,
into slices along the order (``slices.with_slice``).  The carry is joined on
(key, bucket, slice) - the same hash partitioning the inner window needs, so the
rows are shuffled once.  Other keys are one cell each: nothing is carried for
them, and besides their rows only one count a key is shuffled.  Results equal
the single-window form (the tests and the DuckDB oracles check it) and depend on
data only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.plans.keys import same, whole_keys
from civiccases.plans.slices import SLICE_ROWS, with_busy, with_slice


def bucketed_lag(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str,
                 first_default: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``out`` = lag(value) over (key ordered by ``order``); the first row of a key gets ``first_default``."""
    b = with_busy(df, key, slice_rows)
    b = b.withColumn("_bk", F.when(F.col("_busy"), bucket))
    b = with_slice(b, [key, "_bk"], order, slice_rows, among=F.col("_busy"))
    b, keys = whole_keys(b, [key, "_bk", "_slice"], "_k")
    ends = [f"_c{k}" for k in keys]
    last = (b.where("_busy").groupBy(*[F.col(k).alias(c) for k, c in zip(keys, ends)])
            .agg(F.max_by(value, F.struct(*order)).alias("_last")))
    w_small = Window.partitionBy(*ends[:2]).orderBy(*ends[2:])
    carry = last.select(*ends, F.lag("_last").over(w_small).alias("_carry"),
                        (F.row_number().over(w_small) > 1).alias("_has_prev"))
    j = b.join(carry, same(keys, ends), "left")
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = F.when(F.row_number().over(w) == 1,
                  F.when(F.col("_has_prev"), F.col("_carry")).otherwise(first_default)).otherwise(
        F.lag(value).over(w))
    return j.withColumn(out, prev).drop("_busy", "_bk", "_slice", *keys, *ends, "_carry", "_has_prev")
