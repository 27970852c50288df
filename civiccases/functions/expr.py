"""Column expressions shared by every operator.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen; no Python runs per row.  The report clock is always an
explicit ``as_of`` argument, never ``current_timestamp()``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.sources.model import FINISHED_STATUSES, PRIORITIES, STATUSES


def ts_lit(value: datetime | str) -> Column:
    """A timestamp_ntz literal (fixture timestamps are timestamp_ntz)."""
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plus_days(ts: Column | str, days: Column | int) -> Column:
    """Elapsed-time day arithmetic (n x 86,400 s, no calendar)."""
    days = F.lit(days) if isinstance(days, int) else days
    return F.timestamp_add("SECOND", days.cast("long") * F.lit(86400), col_of(ts))


def plus_seconds(ts: Column | str, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_add("SECOND", seconds.cast("long"), col_of(ts))


def count_if(pred: Column) -> Column:
    """COUNT(CASE WHEN p THEN 1 END): NULL counts as no."""
    return F.count(F.when(pred, F.lit(1)))


def sum_if(pred: Column) -> Column:
    """Partial count that merges by sum (used in pre-aggregates)."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("long")


def pct(numerator: Column, denominator: Column) -> Column:
    """ROUND(a * 100.0 / NULLIF(b, 0), 1) as double, rounded through a decimal."""
    ratio = numerator.cast("double") * F.lit(100.0) / F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.round(ratio.cast("decimal(20,10)"), 1).cast("double")


def epoch_days(start: Column | str, end: Column | str) -> Column:
    """EXTRACT(EPOCH FROM (end - start)) / 86400 as double."""
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end)).cast("double") / F.lit(86400e6)


def round1(value: Column) -> Column:
    """NUMERIC(5,1) / ROUND(x, 1) of a double, returned as double."""
    return F.round(value.cast("decimal(20,10)"), 1).cast("double")


def overdue_at(as_of: datetime, status: Column | str = "status",
               deadline: Column | str = "sla_deadline") -> Column:
    """J-12: as_of > deadline AND status NOT IN (resolved, closed, rejected).

    Three-valued like SQL: a NULL deadline with an active status gives NULL.
    """
    return (ts_lit(as_of) > col_of(deadline)) & ~col_of(status).isin(*FINISHED_STATUSES)


def ordinal(value: Column | str, domain: list[str]) -> Column:
    """Declaration-order position of an enum value (NULL for unknown/NULL)."""
    expr = None
    for pos, name in enumerate(domain):
        expr = (F.when(col_of(value) == name, F.lit(pos)) if expr is None
                else expr.when(col_of(value) == name, F.lit(pos)))
    return expr


def status_ordinal(value: Column | str = "status") -> Column:
    return ordinal(value, STATUSES)


def priority_ordinal(value: Column | str = "priority") -> Column:
    return ordinal(value, PRIORITIES)


def falsy_default(value: Column | str, default, empty: str | int = "") -> Column:
    """JS ``x || d``: NULL and the falsy value both become the default."""
    return F.coalesce(F.nullif(col_of(value), F.lit(empty)), F.lit(default))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col_of(value), F.lit(""))


def is_blank(value: Column | str) -> Column:
    """JS falsy for a text field: NULL or ''."""
    return col_of(value).isNull() | (col_of(value) == F.lit(""))


def complaint_number(year: Column, district_code: Column, seq: Column, prefix: str = "AP",
                     digits: int = 5) -> Column:
    """'AP-<year>-<code>-<seq>' with at least ``digits`` digits; wider numbers widen (D6)."""
    return F.concat_ws("-", F.lit(prefix), year.cast("string"), district_code,
                       F.format_string(f"%0{digits}d", seq.cast("long")))


def voter_key(forwarded_for: Column | str, remote_addr: Column | str) -> Column:
    """First forwarded-for address, else the socket address, else 'unknown'."""
    first = F.nullif(F.trim(F.split(col_of(forwarded_for), ",").getItem(0)), F.lit(""))
    return F.coalesce(first, F.nullif(col_of(remote_addr), F.lit("")), F.lit("unknown"))


def with_caller(requests: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, the caller's key, where the requests still carry their raw addresses; others stay as they are."""
    if "forwarded_for" not in requests.columns:
        return requests
    return requests.withColumn(name, voter_key("forwarded_for", "remote_addr")).drop("forwarded_for", "remote_addr")


def identity_hash(value: Column | str, salt: str = "") -> Column:
    """SHA-256 hex of the id number; NULL and '' give NULL (J-05)."""
    v = col_of(value)
    return F.when(is_blank(v), F.lit(None).cast("string")).otherwise(
        F.sha2(F.concat(F.lit(salt), v), 256))


def literal_table(spark, rows: list[tuple], schema: str):
    """A small constant table built JVM-side (inline of literal structs), no Python-backed RDD.

    ``schema`` is a DDL string such as ``"event string, lang string"``.
    """
    from pyspark.sql import types as T

    st = T._parse_datatype_string(schema)
    if not isinstance(st, T.StructType):
        st = T.StructType([T.StructField("value", st)])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, st.fields)])
               for row in rows]
    if not structs:
        return spark.createDataFrame([], st)
    return spark.range(1).select(F.inline(F.array(*structs))).select(
        *[F.col(f.name).cast(f.dataType) for f in st.fields])
