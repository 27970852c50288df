"""Pages by distributed selection equal sorted slices, and their plans hold no bucket in one task."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from civiccases.plans import paging
from civiccases.plans.paging import Key, page

T = datetime(2024, 1, 1)


def feed() -> list[Key]:
    return [Key(F.col("votes"), descending=True, nulls_first=True), Key(F.col("at"), "time", descending=True, nulls_first=True),
            Key(F.col("id"))]


def ascending() -> list[Key]:
    return [Key(F.col("at"), "time"), Key(F.col("votes")), Key(F.col("id"), descending=True)]


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows share votes and instant; the others spread, with nulls."""
    rng = random.Random(4)
    data = [(i, 7 if i % 2 else rng.choice([None, 0, 1, 2, 50, -3, 10 ** 12]),
             T if i % 2 else rng.choice([None, T + timedelta(microseconds=rng.randrange(10 ** 13))])) for i in range(4000)]
    return spark.createDataFrame(data, "id long, votes long, at timestamp_ntz").repartition(5).persist()


def sorted_ids(rows, keys):
    return [r["id"] for r in rows.orderBy(*[k.sort for k in keys]).collect()]


@pytest.mark.parametrize("order,size", [(feed, 150), (ascending, 20)])
def test_pages_of_every_depth(rows, order, size, monkeypatch):
    keys = order()
    monkeypatch.setattr(paging, "DIGITS", 5)
    want = sorted_ids(rows, keys)
    for number in {1, 2, 7, 2000 // size, 2600 // size, 3999 // size + 1, 999}:
        got = [r["id"] for r in page(rows, keys, number, size, take=30).collect()]
        assert got == want[(number - 1) * size:number * size], number


def test_literals_bound_the_scan(spark, rows, tmp_path):
    """A deep page inside half a table of one instant: a top-k over a scan whose pushed filters hold the range."""
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    got = page(stored, feed(), 120, 10, take=50)
    assert [r["id"] for r in got.collect()] == sorted_ids(rows, feed())[1190:1200]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(id," in plan and "LessThanOrEqual(id," in plan and "votes" in plan[plan.index("PushedFilters"):]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    limit = int(plan[plan.index("limit=") + 6:].split(",")[0])
    assert limit <= 60


def test_no_rows(spark, rows):
    assert page(rows.limit(0), feed(), 1, 20).count() == 0 and page(rows.limit(0), feed(), 400, 20).count() == 0
    with pytest.raises(ValueError):
        page(rows, feed(), 0, 20)
