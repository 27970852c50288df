"""Every registered query against its DuckDB oracle on the sf0.001 testdata (the driver's gate, small)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from civiccases import registry
from civiccases.oracle.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in E.queries().items() if name in registry.QUERIES}
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == registry.QUERIES.keys() and not QUERIES.keys() - ORACLE.keys()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25 and df.columns[:3] == ["district_id", "district", "district_code"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg, _ = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert ok, msg
