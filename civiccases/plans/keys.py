"""Keys without NULL: joins and windows on them share one partitioning.

A null-safe join hashes other expressions than a window on the same columns
does, so the rows would be shuffled twice, and Catalyst does not see that a left
join on it is not needed.  A copy with a stand-in for NULL and a flag beside it
is joined by plain equality instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stand_in(kind: T.DataType) -> Column:
    """Any value of the type; of times one that sorts before all others in use."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("0001-01-01").cast(kind)
    return F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)


def whole_keys(df: DataFrame, columns: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """``df`` with never-null columns that are equal exactly where ``columns`` are, NULL equal to NULL; and their names."""
    added = {}
    for i, name in enumerate(columns):
        added[f"{prefix}{i}"] = F.coalesce(F.col(name), stand_in(df.schema[name].dataType))
        added[f"{prefix}{i}n"] = F.col(name).isNull()
    return df.withColumns(added), list(added)


def same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & (F.col(a) == F.col(b))
    return out
