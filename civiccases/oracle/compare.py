"""Order-insensitive comparison of a Spark result with a DuckDB oracle result.

Column names and types, row count and a digest of the normalised rows
(order-insensitive), as the driver's correctness gate does.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

TESTDATA_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                   "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TESTDATA_TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def duck_type(dt) -> str:
    """The DuckDB type name a Spark result column must match."""
    from pyspark.sql import types as T
    names = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR", T.DoubleType: "DOUBLE",
             T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE"}
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    return names.get(type(dt), dt.simpleString().upper())


def compare(df, con, sql: str) -> tuple[bool, str, int]:
    """(equal, message, rows) for a Spark DataFrame against the oracle statement."""
    s_types = {f.name: duck_type(f.dataType) for f in df.schema.fields}
    o_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if s_types != o_types:
        diff = {k: (s_types.get(k), o_types.get(k)) for k in set(s_types) | set(o_types)
                if s_types.get(k) != o_types.get(k)}
        return False, f"types differ (spark, oracle): {diff}", -1
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    if sorted(s_cols) != sorted(o_cols):
        return False, f"columns spark={sorted(s_cols)} oracle={sorted(o_cols)}", len(s_rows)
    if len(s_rows) != len(o_rows):
        return False, f"rows spark={len(s_rows)} oracle={len(o_rows)}", len(s_rows)
    hs, ks = digest(s_cols, s_rows)
    ho, ko = digest(o_cols, o_rows)
    if hs != ho:
        only_s = sorted(set(ks) - set(ko))[:3]
        only_o = sorted(set(ko) - set(ks))[:3]
        return False, f"values differ; spark-only {only_s} oracle-only {only_o}", len(s_rows)
    return True, "", len(s_rows)
