"""Scalar helpers of SURVEY section 2.6."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from civiccases.functions import expr


def test_voter_key(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), ("", None), (None, None)],
                               "fwd string, addr string")
    got = [r[0] for r in df.select(expr.voter_key("fwd", "addr")).collect()]
    assert got == ["1.2.3.4", "9.9.9.9", "unknown", "unknown"]


def test_falsy_default_and_blank(spark):
    df = spark.createDataFrame([("",), (None,), ("urgent",)], "p string")
    got = [r[0] for r in df.select(expr.falsy_default("p", "normal")).collect()]
    assert got == ["normal", "normal", "urgent"]


def test_identity_hash_and_salt(spark):
    df = spark.createDataFrame([("123412341234",), ("",), (None,)], "a string")
    got = [r[0] for r in df.select(expr.identity_hash("a")).collect()]
    assert got == [hashlib.sha256(b"123412341234").hexdigest(), None, None]
    salted = df.select(expr.identity_hash("a", salt="s")).first()[0]
    assert salted == hashlib.sha256(b"s123412341234").hexdigest()


def test_pct_rounds_half_up_and_null_on_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (0, 0), (249, 2000)], "a long, b long")
    got = [r[0] for r in df.select(expr.pct(F.col("a"), F.col("b"))).collect()]
    assert got == [12.5, 33.3, 66.7, None, 12.5]


def test_literal_table(spark):
    df = expr.literal_table(spark, [("a", 1), ("b", 2)], "k string, v long")
    assert sorted(map(tuple, df.collect())) == [("a", 1), ("b", 2)]
    assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
