"""Versioned buckets: a change rewrites what it touches, a version is published whole or not at all, replays repeat it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiccases.sources.versions import Versions
from civiccases.streaming.streams import run_dir

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def _rows(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


@pytest.fixture
def table(spark):
    t = Versions(spark, run_dir(spark, "test-versions"), SCHEMA, buckets=8)
    t.create(spark.range(200).select("id", F.lit("old").alias("v")))
    return t


def test_a_change_rewrites_its_buckets(spark, table):
    changed = spark.createDataFrame([(3, "new"), (500, "added")], SCHEMA)
    table.publish(7, changed)
    assert table.versions() == [0, 7] and table.latest() == 7 and table.latest(7) == 0
    want = {i: "old" for i in range(200)} | {3: "new", 500: "added"}
    assert dict(_rows(table.read(7))) == want and {v for _, v in _rows(table.read(0))} == {"old"}
    touched = table.touched(changed, "id")
    written = {f.split("bucket=")[1].split("/")[0] for f in table.read(7).inputFiles() if "/v=7/" in f}
    assert written == set(map(str, touched)) and len(touched) <= 2
    one = table.read(7, touched[:1])
    assert all(f"/bucket={touched[0]}/" in f for f in one.inputFiles())
    assert one.count() == table.read(7).where(table.bucket() == touched[0]).count()


def test_a_version_that_was_not_finished_is_not_there(spark, table, monkeypatch):
    before = _rows(table.read(0))
    changed = spark.createDataFrame([(i, "new") for i in range(0, 200, 9)], SCHEMA)
    with monkeypatch.context() as mp:
        def lost(*_):
            raise RuntimeError("lost")
        mp.setattr(spark, "createDataFrame", lost)  # the data is written, its manifest is not
        with pytest.raises(RuntimeError):
            table.publish(1, changed)
    assert table.versions() == [0] and _rows(table.read(table.latest())) == before
    table.publish(1, changed)
    first = _rows(table.read(1))
    table.publish(2, spark.createDataFrame([(1, "later")], SCHEMA))
    table.publish(1, changed)          # a replay starts from the version before it and repeats it
    assert _rows(table.read(1)) == first and dict(_rows(table.read(2)))[1] == "later"
    table.create(spark.range(3).select("id", F.lit("x").alias("v")))  # created once
    assert len(_rows(table.read(0))) == 200


def test_nothing_changed(spark, table):
    table.publish(4, spark.createDataFrame([], SCHEMA))
    assert _rows(table.read(4)) == _rows(table.read(0)) and table.read(4, []).count() == 0
