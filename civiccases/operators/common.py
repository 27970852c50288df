"""Small helpers shared by the operators: dimension lookups and sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.functions.expr import overdue_at, priority_ordinal
from civiccases.plans.paging import Key
from civiccases.sources.model import Model

# No join is hinted: a model may be loaded from any tables, so no size is known
# here.  Statistics and AQE broadcast what they measure to be small (districts,
# mandals and departments in any real state).


def district_dim(m: Model, *cols: str) -> DataFrame:
    return m.districts.select(F.col("id").alias("_d_id"), *cols)


def department_dim(m: Model, *cols: str) -> DataFrame:
    return m.departments.select(F.col("id").alias("_dep_id"), *cols)


def mandal_dim(m: Model, *cols: str) -> DataFrame:
    return m.mandals.select(F.col("id").alias("_m_id"), *cols)


def with_names(df: DataFrame, m: Model, district: bool = True, department: bool = True,
               mandal: bool = False, district_code: bool = False, dept_code: bool = False) -> DataFrame:
    """Inner joins to districts / departments (FK NOT NULL), left join to mandals."""
    if district:
        cols = [F.col("name").alias("district")] + ([F.col("code").alias("district_code")] if district_code else [])
        df = df.join(district_dim(m, *cols), F.col("district_id") == F.col("_d_id"), "inner").drop("_d_id")
    if department:
        cols = [F.col("name").alias("department")] + ([F.col("code").alias("dept_code")] if dept_code else [])
        df = df.join(department_dim(m, *cols), F.col("department_id") == F.col("_dep_id"), "inner").drop("_dep_id")
    if mandal:
        df = df.join(mandal_dim(m, F.col("name").alias("mandal")), F.col("mandal_id") == F.col("_m_id"),
                     "left").drop("_m_id")
    return df


def live_overdue(m: Model) -> Column:
    """``is_overdue`` as the reference's generated column would show it at ``as_of`` (J-12)."""
    return overdue_at(m.as_of)


def queue_keys() -> list[Key]:
    """Officer queue: overdue DESC (NULLs first, as PostgreSQL), priority by enum DESC, created ASC, id."""
    return [Key(F.col("is_overdue").cast("int"), descending=True, nulls_first=True),
            Key(priority_ordinal("priority"), descending=True, nulls_first=True),
            Key(F.col("created_at"), "time"), Key(F.col("id"))]


def queue_order() -> list[Column]:
    return [key.sort for key in queue_keys()]
