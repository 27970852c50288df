"""A-01..A-09: dashboard aggregates.

Plan shape for every per-dimension report (SURVEY 4.2): aggregate the fact
table by the dimension key first (partial + final hash aggregate, so each map
task ships one row per key), then join the few groups to the dimension.  The
literal ``dims LEFT JOIN complaints`` would broadcast or shuffle every
complaint instead.  Averages travel as exact (sum of microseconds, count)
pairs, the sum a decimal that does not overflow, and are divided once at the
end, never averaged twice.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiccases.functions.expr import pct, round1, sum_if, ts_lit
from civiccases.operators.common import district_dim, live_overdue
from civiccases.sources.model import RECENT_K, TOP_ISSUES_K, Model

# Measures of the shared (district, department) pre-aggregate.  Each is a
# count that merges by sum; the two averages are kept as microseconds + count.
def _measures(m: Model) -> dict:
    as_of = m.as_of
    created, resolved_at, status = F.col("created_at"), F.col("resolved_at"), F.col("status")
    d7, d14, h24 = (ts_lit(as_of - timedelta(days=7)), ts_lit(as_of - timedelta(days=14)),
                    ts_lit(as_of - timedelta(hours=24)))
    took = F.timestamp_diff("MICROSECOND", created, resolved_at)
    is_resolved = status == "resolved"
    return {
        "total": F.count(F.lit(1)),
        "resolved": sum_if(is_resolved),
        "in_progress": sum_if(status == "in_progress"),
        "pending": sum_if(status == "submitted"),
        "overdue": sum_if(live_overdue(m)),
        "emergency": sum_if(F.col("priority") == "emergency"),
        "last_7_days": sum_if(created >= d7),
        "last_24_hours": sum_if(created >= h24),
        "prev_7_days": sum_if((created >= d14) & (created < d7)),
        "resolved_this_week": sum_if(is_resolved & (resolved_at >= d7)),
        "resolved_last_week": sum_if(is_resolved & (resolved_at >= d14) & (resolved_at < d7)),
        # every row with resolved_at (dept_summary's average)
        "done_time": F.sum(took.cast("decimal(19,0)")).cast("decimal(38,0)"),
        "done_n": F.count(took),
        # status 'resolved' only (CM's average)
        "res_time": F.sum(F.when(is_resolved, took).cast("decimal(19,0)")).cast("decimal(38,0)"),
        "res_n": F.count(F.when(is_resolved, took)),
    }


def _agg(m: Model, keys: list[str], names: list[str]) -> DataFrame:
    meas = _measures(m)
    return m.complaints.groupBy(*keys).agg(*[meas[n].alias(n) for n in names])


def _avg_days(time: str, n: str):
    return round1(F.col(time).cast("double") / F.nullif(F.col(n), F.lit(0)).cast("double") / F.lit(86400e6))


def _fill0(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names],
                     *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])


# ---------------------------------------------------------------- A-01

def public_totals(m: Model) -> DataFrame:
    names = ["total", "resolved", "in_progress", "pending", "overdue"]
    meas = _measures(m)
    return m.complaints.agg(*[meas[n].cast("long").alias(n) for n in names])


# ---------------------------------------------------------------- A-02 / A-06

def _by_district(m: Model, names: list[str], agg: DataFrame | None = None) -> DataFrame:
    per = agg if agg is not None else _agg(m, ["district_id"], names)
    dims = district_dim(m, F.col("name").alias("district"), F.col("code").alias("district_code"))
    # dims (25 rows) LEFT JOIN per-district counts (<= 25 rows): both sides are tiny.
    joined = dims.join(per, F.col("_d_id") == F.col("district_id"), "left").drop("district_id")
    return _fill0(joined.withColumnRenamed("_d_id", "district_id"), names)


def district_summary(m: Model, agg: DataFrame | None = None) -> DataFrame:
    names = ["total", "resolved", "in_progress", "overdue"]
    df = _by_district(m, names, agg)
    return df.select("district_id", "district", "district_code", *names,
                     pct(F.col("resolved"), F.col("total")).alias("resolution_pct")
                     ).orderBy(F.desc("total"), "district_id")


def cm_by_district(m: Model, agg: DataFrame | None = None) -> DataFrame:
    names = ["total", "resolved", "overdue", "emergency"]
    df = _by_district(m, names, agg)
    return df.select("district_id", "district", "district_code", *names,
                     pct(F.col("resolved"), F.col("total")).alias("resolution_pct")
                     ).orderBy(F.desc("total"), "district_id")


# ---------------------------------------------------------------- A-03 / A-07 / A-08

def _by_department(m: Model, names: list[str], agg: DataFrame | None = None, active_only: bool = False,
                   with_complaints_only: bool = False) -> DataFrame:
    per = agg if agg is not None else _agg(m, ["department_id"], names)
    deps = m.departments
    if active_only:
        deps = deps.filter(F.col("is_active"))
    dims = deps.select(F.col("id").alias("_dep_id"), F.col("name").alias("department"), "code", "sla_days")
    how = "inner" if with_complaints_only else "left"
    joined = dims.join(per, F.col("_dep_id") == F.col("department_id"), how).drop("department_id")
    return _fill0(joined.withColumnRenamed("_dep_id", "department_id"),
                  [n for n in names if n not in ("done_time", "res_time")])


def dept_summary(m: Model, agg: DataFrame | None = None) -> DataFrame:
    names = ["total", "resolved", "overdue", "done_time", "done_n"]
    df = _by_department(m, names, agg)
    return df.select("department_id", "department", "code", "sla_days", "total", "resolved", "overdue",
                     _avg_days("done_time", "done_n").alias("avg_resolution_days")
                     ).orderBy(F.desc("total"), "department_id")


def cm_by_department(m: Model, agg: DataFrame | None = None) -> DataFrame:
    names = ["total", "resolved", "overdue"]
    df = _by_department(m, names, agg, active_only=True)
    return df.select("department_id", "department", "code", "sla_days", *names,
                     pct(F.col("resolved"), F.col("total")).alias("resolution_pct")
                     ).orderBy(F.desc("total"), "department_id")


def sla_performance(m: Model, agg: DataFrame | None = None) -> DataFrame:
    """Departments with at least one complaint (the reference's WHERE c.id IS NOT NULL)."""
    names = ["total", "overdue"]
    per = agg if agg is not None else _agg(m, ["department_id"], names)
    per = per.filter(F.col("total") > 0)
    df = _by_department(m, names, per, with_complaints_only=True)
    return (df.select("department_id", "department", "sla_days", "total", F.col("overdue").alias("breached"),
                      pct(F.col("overdue"), F.col("total")).alias("breach_pct"))
              .orderBy(F.col("breach_pct").desc_nulls_last(), F.col("department_id")))


# ---------------------------------------------------------------- A-04

def officer_dashboard(m: Model, agg: DataFrame | None = None) -> DataFrame:
    """Every scope at once: one row per department (an officer's view) + one 'all' row."""
    names = ["total", "pending", "in_progress", "resolved", "overdue"]
    per = (_agg(m, ["department_id"], names) if agg is None
           else agg.groupBy("department_id").agg(*[F.sum(n).alias(n) for n in names]))
    dims = m.departments.select(F.col("id").alias("_dep_id"))
    by_dept = _fill0(dims.join(per, F.col("_dep_id") == F.col("department_id"), "left")
                     .drop("department_id").withColumnRenamed("_dep_id", "department_id"), names)
    everyone = per.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names]) \
                  .withColumn("department_id", F.lit(None).cast("int"))
    out = by_dept.withColumn("scope", F.lit("department")).unionByName(everyone.withColumn("scope", F.lit("all")))
    return out.select("scope", "department_id", "total", F.col("pending").alias("new_complaints"),
                      "in_progress", "resolved", "overdue")


# ---------------------------------------------------------------- A-05

CM_TOTALS = ["total", "resolved", "in_progress", "pending", "overdue", "emergency", "last_7_days",
             "last_24_hours", "prev_7_days", "resolved_this_week", "resolved_last_week"]


def cm_totals(m: Model, agg: DataFrame | None = None, one_row: DataFrame | None = None) -> DataFrame:
    """``agg``: per-group partial sums to add up; ``one_row``: totals already summed."""
    names = CM_TOTALS + ["res_time", "res_n"]
    if one_row is not None:
        one = one_row
    elif agg is None:
        meas = _measures(m)
        one = m.complaints.agg(*[meas[n].alias(n) for n in names])
    else:
        one = agg.agg(*[F.sum(n).alias(n) for n in names])
    return one.select(*[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in CM_TOTALS],
                      _avg_days("res_time", "res_n").alias("avg_resolution_days"))


# ---------------------------------------------------------------- A-09

BUNDLE_MEASURES = CM_TOTALS + ["done_time", "done_n", "res_time", "res_n"]


def dashboard_cube(m: Model) -> DataFrame:
    """The one scan behind every dashboard: counts per (district, department).

    At most |districts| x |departments| rows whatever the data size, so the
    shuffle after the partial aggregate is a few KB per map task.
    """
    return _agg(m, ["district_id", "department_id"], BUNDLE_MEASURES)


def dashboard_levels(m: Model) -> DataFrame:
    """The cube rolled up to every level the dashboards read, in one extra shuffle.

    ``cube()`` over the (district, department) counts yields the grouping
    sets (district, department), (district), (department) and () at once;
    ``level`` tells them apart (0, 1, 2, 3).  Its input is the bounded cube,
    not the complaints, so the Expand it plans is over at most
    |districts| x |departments| rows.
    """
    cube = dashboard_cube(m)
    return (cube.cube("district_id", "department_id")
                .agg(*[F.sum(n).alias(n) for n in BUNDLE_MEASURES], F.grouping_id().alias("level")))


def dashboard_bundle(m: Model, levels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Public (3) + CM (6) dashboards as one DataFrame a section, for callers that show sections apart.

    Nothing runs here.  Each section that is shown scans complaints for itself
    unless ``levels`` (a few hundred rows) was stored by the caller; to compute
    all nine at once use ``dashboard_long``.
    """
    from civiccases.operators import lookups

    if levels is None:
        levels = dashboard_levels(m)
    by_d = levels.filter(F.col("level") == 1).drop("department_id", "level")
    by_dep = levels.filter(F.col("level") == 2).drop("district_id", "level")
    tot = levels.filter(F.col("level") == 3).drop("district_id", "department_id", "level")
    pub_totals = tot.select(*[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n)
                              for n in ["total", "resolved", "in_progress", "pending", "overdue"]])
    return {
        "public_totals": pub_totals,
        "district_summary": district_summary(m, by_d),
        "dept_summary": dept_summary(m, by_dep),
        "cm_totals": cm_totals(m, one_row=tot),
        "cm_by_district": cm_by_district(m, by_d),
        "cm_by_department": cm_by_department(m, by_dep),
        "sla_performance": sla_performance(m, by_dep),
        "recent_activity": lookups.recent_activity(m),
        "top_issues": lookups.top_issues(m),
    }


# section -> (level of the cube, metrics); level 1 is per district, 2 per department, 3 the total
SECTIONS = {
    "public_totals": (3, ["total", "resolved", "in_progress", "pending", "overdue"]),
    "district_summary": (1, ["total", "resolved", "in_progress", "overdue", "resolution_pct"]),
    "dept_summary": (2, ["total", "resolved", "overdue", "avg_done_days"]),
    "cm_totals": (3, CM_TOTALS + ["avg_resolved_days"]),
    "cm_by_district": (1, ["total", "resolved", "overdue", "emergency", "resolution_pct"]),
    "cm_by_department": (2, ["total", "resolved", "overdue", "resolution_pct"]),
    "sla_performance": (2, ["total", "breached", "breach_pct"]),
}
# the two averages have the same name in the reports that show them
METRIC_NAMES = {"avg_done_days": "avg_resolution_days", "avg_resolved_days": "avg_resolution_days"}


def _ranked(top: DataFrame, order: list, section: str, metric: str, value) -> DataFrame:
    """(section, position, metric, value, complaint number) of a top-k list of bounded length."""
    pos = F.row_number().over(Window.orderBy(*order)).cast("long")
    return top.select(F.lit(section).alias("section"), pos.alias("key"), F.lit(metric).alias("metric"),
                      value.cast("double").alias("value"), F.col("complaint_no").alias("label"))


def dashboard_long(m: Model) -> DataFrame:
    """All nine dashboard sections as (section, key, metric, value, label) rows.

    One scan of complaints feeds the seven aggregate sections: the cube's
    levels join their dimension rows once, and each joined row (25 districts,
    the departments, one total) is exploded into the sections that show it.
    The two top-k lists are top-k scans of their own.  ``key`` is the
    district, the department or the position in a list; ``label`` the
    complaint number in a list.
    """
    from civiccases.operators import lookups

    dims = (m.districts.select(F.lit(1).alias("_lv"), F.col("id").cast("long").alias("key"), F.lit(True).alias("_active"))
            .unionByName(m.departments.select(F.lit(2).alias("_lv"), F.col("id").cast("long").alias("key"),
                                              F.col("is_active").alias("_active")))
            .unionByName(m.complaints.sparkSession.range(1).select(
                F.lit(3).alias("_lv"), F.lit(None).cast("long").alias("key"), F.lit(True).alias("_active"))))
    levels = dashboard_levels(m).where("level > 0").select(
        F.col("level").cast("int").alias("level"), F.coalesce("district_id", "department_id").cast("long").alias("_key"),
        *BUNDLE_MEASURES)
    wide = dims.join(levels, (F.col("_lv") == F.col("level")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    wide = _fill0(wide, [n for n in BUNDLE_MEASURES if n not in ("done_time", "res_time")]).withColumns({
        "resolution_pct": pct(F.col("resolved"), F.col("total")), "breached": F.col("overdue"),
        "breach_pct": pct(F.col("overdue"), F.col("total")),
        "avg_done_days": _avg_days("done_time", "done_n"), "avg_resolved_days": _avg_days("res_time", "res_n")})
    shown = {"cm_by_department": F.col("_active"), "sla_performance": F.col("total") > 0}
    cells = F.array(*[
        F.when((F.col("_lv") == level) & shown.get(section, F.lit(True)),
               F.struct(F.lit(section).alias("section"), F.lit(METRIC_NAMES.get(metric, metric)).alias("metric"),
                        F.col(metric).cast("double").alias("value")))
        for section, (level, metrics) in SECTIONS.items() for metric in metrics])
    counted = (wide.select("key", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c"))
               .select("c.section", "key", "c.metric", "c.value", F.lit(None).cast("string").alias("label")))
    recent = lookups.top_rows(m, m.complaints, lookups.recent_order(), RECENT_K)
    issues = lookups.top_rows(m, m.complaints.filter(F.col("upvote_count") > 0), lookups.top_order(), TOP_ISSUES_K)
    return (counted.unionByName(_ranked(recent, lookups.recent_order(), "recent_activity", "is_overdue",
                                        live_overdue(m).cast("int")))
                   .unionByName(_ranked(issues, lookups.top_order(), "top_issues", "upvote_count",
                                        F.col("upvote_count"))))
