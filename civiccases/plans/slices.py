"""Slices of hot cells: the second level of the bucketed orderings.

A cell (time bucket, or key and time bucket) is the unit that one task sorts.
The largest ``MAX_HOT`` cells, if they hold more than ``rows`` rows, are hot
and are cut into slices of about equal size (equi-depth) along the whole order
key, tie-breaks included: rows of one instant are cut between two ids.

The cuts come from a mergeable sample sketch.  A row belongs to the sample of
its hot cell if a hash of its order key falls under the cell's rate, which is
set by the cell's count to ``SAMPLES`` rows a slice.  Samples of tasks merge by
union, every task decides alike (a retried one too), and the sorted sample's
every ``SAMPLES``-th key is a cut.  A slice is then within about an eighth of
its target (one standard deviation), whatever the values' distribution.

What is broadcast is bounded: at most ``MAX_HOT`` cells with ``MAX_CUTS`` cuts
in all; beyond that, slices get larger in proportion.  Without a hot cell
nothing is sampled: the sample's join side is empty, which adaptive execution
sees before it reads a row for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: rows that one task sorts without a cut
SLICE_ROWS = 1_000_000
#: rows of a part, where a table is dealt by its number of rows
PART_ROWS = 250_000
#: most cells that are cut, and most cuts in all
MAX_HOT, MAX_CUTS = 10_000, 65_536
#: most keys whose cells are looked at; another key has at most this part of all rows
MAX_BUSY = 100_000
#: sampled rows a slice
SAMPLES = 64
#: cuts looked through together: a row compares with the group's first cuts, then within one group
GROUP = 64


def parts_for(spark: SparkSession, n_rows: int) -> int:
    """Parts of ``PART_ROWS`` rows that ``n_rows`` need, or 0 for fewer than there are cores: these are left to the session.

    Its number of shuffle partitions does not grow with the rows, and AQE merges
    partitions by their compressed size, which says little of rows of a few keys.
    """
    parts = -(-n_rows // PART_ROWS)
    return parts if parts > spark.sparkContext.defaultParallelism else 0


def _same(cell: list[str], keys: list[str]) -> Column:
    out = F.lit(True)
    for c, k in zip(cell, keys):
        out = out & F.col(c).eqNullSafe(F.col(k))
    return out


def cell_counts(df: DataFrame, cell: list[str], keys: list[str]) -> DataFrame:
    """(keys, _rows): the rows of each cell."""
    return df.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, cell)]).agg(F.count(F.lit(1)).alias("_rows"))


def hot_cells(counts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, _rows, _n): the cells of more than ``rows`` rows, largest first, and the number of slices of each."""
    hot = counts.where(F.col("_rows") > rows).orderBy(F.desc("_rows"), *keys).limit(MAX_HOT)
    every = F.sum("_rows").over(Window.partitionBy(F.lit(0)))  # over MAX_HOT rows at most
    depth = F.greatest(F.lit(rows).cast("double"), every / F.lit(MAX_CUTS))
    return hot.select(*keys, "_rows", F.ceil(F.col("_rows") / depth).alias("_n"))


def with_busy(df: DataFrame, key: str, rows: int = SLICE_ROWS, name: str = "_busy") -> DataFrame:
    """Add ``name``: whether the row's key has more than ``rows`` rows (of the ``MAX_BUSY`` largest such keys, else false).

    One partial count a key crosses the shuffle, where (key, time) cells would be nearly one a row.
    """
    busy = (cell_counts(df.select(key), [key], ["_yk"]).where(F.col("_rows") > rows)
            .orderBy(F.desc("_rows"), "_yk").limit(MAX_BUSY).select("_yk", F.lit(True).alias(name)))
    return (df.join(F.broadcast(busy), F.col(key).eqNullSafe(F.col("_yk")), "left").drop("_yk")
            .withColumn(name, F.coalesce(name, F.lit(False))))


def cuts_of(df: DataFrame, cell: list[str], order: list[str], hot: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _cuts): for each hot cell its cuts in order, in groups of ``GROUP``."""
    me = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rate = F.greatest(F.lit(1), F.floor(F.col("_rows") / (F.col("_n") * SAMPLES)))
    sampled = (df.join(F.broadcast(hot), _same(cell, keys), "inner")
               .where(F.pmod(F.xxhash64(*order), rate) == 0).select(*keys, "_n", me.alias("_me")))
    found = sampled.groupBy(*keys).agg(F.sort_array(F.collect_list("_me")).alias("_all"), F.max("_n").alias("_n"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n").cast("int") - 1)),
                     lambda i: F.get(F.col("_all"), F.floor(i * F.size("_all") / F.col("_n")).cast("int")))
    cuts = F.array_distinct(F.filter(at, lambda x: x.isNotNull()))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_list") - 1) / GROUP).cast("int")),
                         lambda g: F.slice("_list", g * GROUP + 1, F.lit(GROUP)))
    return found.select(*keys, cuts.alias("_list")).where(F.size("_list") > 0).select(*keys, groups.alias("_cuts"))


def slice_of(order: list[str]) -> Column:
    """The number of cuts (column ``_cuts``) at or before the row; 0 without cuts."""
    me = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    group = F.size(F.filter("_cuts", lambda g: F.get(g, F.lit(0)) <= me)) - 1
    inside = F.size(F.filter(F.get("_cuts", group), lambda x: x <= me))
    return F.when(F.col("_cuts").isNull() | (group < 0), F.lit(0)).otherwise(group * GROUP + inside).cast("long")


def with_slice(df: DataFrame, cell: list[str], order: list[str], rows: int = SLICE_ROWS,
               name: str = "_slice", among: Column | None = None) -> DataFrame:
    """Add ``name``: 0 in a cell that is not hot, else the number of the cell's cuts at or before the row.

    Slice numbers never decrease along ascending ``order`` (NULL first).  With
    ``among``, only the cells of these rows, which are whole, may be hot.
    """
    keys = [f"_h{i}" for i in range(len(cell))]
    narrow = (df if among is None else df.where(among)).select(*dict.fromkeys([*cell, *order]))
    cuts = cuts_of(narrow, cell, order, hot_cells(cell_counts(narrow, cell, keys), keys, rows), keys)
    return (df.join(F.broadcast(cuts), _same(cell, keys), "left")
            .withColumn(name, slice_of(order)).drop(*keys, "_cuts"))


def slice_counts(df: DataFrame, cell: list[str], order: list[str], cuts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _slice, _in): the rows of each slice of the hot cells."""
    return (df.join(F.broadcast(cuts), _same(cell, keys), "inner").groupBy(*keys, slice_of(order).alias("_slice"))
            .agg(F.count(F.lit(1)).alias("_in")))
