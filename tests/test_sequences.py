"""The bucketed orderings equal their single-window forms, and hot cells are cut at equal depths."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from civiccases.plans import slices
from civiccases.plans.ranking import global_rank
from civiccases.plans.sequences import bucketed_lag
from civiccases.plans.slices import with_slice


def _events(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else None), t + timedelta(hours=7 * (i // 2)),
             ["a", "b", "c"][i % 3], i % 4 == 0) for i in range(200)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v string, f boolean")


def test_bucketed_lag_equals_window(spark):
    df = _events(spark)
    got = bucketed_lag(df, "k", F.date_trunc("day", "ts"), ["ts", "id"], "v", "prev", F.lit("base"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.withColumn("prev", F.when(F.row_number().over(w) == 1, F.lit("base")).otherwise(F.lag("v").over(w)))
    assert sorted(got.select("id", "prev").collect()) == sorted(want.select("id", "prev").collect())


def _hot_day(spark):
    """A third of all rows at one instant, a third in one hour, the others in hours that differ by microseconds."""
    t = datetime(2024, 1, 1)
    at = lambda i: (t if i % 3 == 0 else t + timedelta(hours=3, seconds=i) if i % 3 == 1
                    else t + timedelta(days=1 + i % 7, microseconds=i))
    rows = [(i, ["hot", "hot", "cold", None][i % 4], at(i) if i % 97 else None, "abc"[i % 3], i % 4 == 0)
            for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v string, f boolean").repartition(5)


def test_hot_cells_are_sliced_along_the_order(spark):
    df = _hot_day(spark).withColumn("b", F.date_trunc("hour", "ts"))
    cut = with_slice(df, ["b"], ["ts", "id"], rows=100)
    assert cut.columns == df.columns + ["_slice"] and cut.count() == 3000
    assert cut.groupBy("b", "_slice").count().agg(F.max("count")).first()[0] <= 200
    assert cut.where("b = timestamp_ntz'2024-01-01 00:00:00'").select("_slice").distinct().count() > 5
    # slices follow the order
    w = Window.partitionBy("b").orderBy("ts", "id")
    back = cut.withColumn("back", F.lag("_slice").over(w) > F.col("_slice")).where("back")
    assert back.count() == 0
    assert with_slice(df, ["b"], ["ts", "id"]).where("_slice != 0").count() == 0


def test_one_instant_is_cut_by_its_tie_break(spark):
    """A cell with half its rows at one microsecond: no slice over twice the target; ranks and sequences stay right."""
    t = datetime(2024, 1, 1, 5)
    rows = [(i * 7919 % 20_011, "hot", t if i % 2 else t + timedelta(microseconds=i * 131 % 50_000), "abc"[i % 3], i % 5 == 0)
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v string, f boolean").repartition(6)
    cut = with_slice(df.withColumn("b", F.date_trunc("hour", "ts")), ["b"], ["ts", "id"], rows=1000)
    sizes = [r["count"] for r in cut.groupBy("b", "_slice").count().collect()]
    assert max(sizes) <= 2000 and 15 <= len(sizes) <= 25 and sum(sizes) == 20_000
    back = cut.withColumn("back", F.lag("_slice").over(Window.partitionBy("b").orderBy("ts", "id")) > F.col("_slice"))
    assert back.where("back").isEmpty()
    got = global_rank(df, F.date_trunc("hour", "ts"), ["ts", "id"], "n", slice_rows=1000)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("ts", "id")).cast("long"))
    assert sorted(got.select("id", "n").collect()) == sorted(want.select("id", "n").collect())


def test_cuts_stay_within_their_bound(spark, monkeypatch):
    """More slices than may be broadcast: slices grow, in proportion."""
    monkeypatch.setattr(slices, "MAX_CUTS", 8)
    df = spark.range(4000).select(F.col("id") % 2, F.col("id").alias("o")).toDF("c", "o")
    sizes = [r["count"] for r in with_slice(df, ["c"], ["o"], rows=50).groupBy("c", "_slice").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) <= 8 and max(sizes) <= 1000


def test_rank_and_sequences_over_sliced_cells(spark):
    df = _hot_day(spark)
    w = Window.orderBy("ts", "id")
    got = global_rank(df, F.date_trunc("hour", "ts"), ["ts", "id"], "n", 5, slice_rows=50)
    want = df.withColumn("n", F.row_number().over(w).cast("long") + 4)
    assert sorted(got.select("id", "n").collect()) == sorted(want.select("id", "n").collect())
    day = F.date_trunc("day", "ts")
    per_key = Window.partitionBy("k").orderBy("ts", "id")
    got = bucketed_lag(df, "k", day, ["ts", "id"], "v", "prev", F.lit("base"), slice_rows=50)
    want = df.withColumn("prev", F.when(F.row_number().over(per_key) == 1, F.lit("base"))
                         .otherwise(F.lag("v").over(per_key)))
    assert sorted(got.select("id", "prev").collect()) == sorted(want.select("id", "prev").collect())
