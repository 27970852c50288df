"""Properties over the sf0.001 testdata model, and plan-shape checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civiccases.operators import intake, lifecycle, lookups, reports, votes
from civiccases.sources import adapter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return adapter.load_testdata_model(spark, SF)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_agree(model):
    total = reports.public_totals(model).first()["total"]
    by_d = reports.district_summary(model).agg(F.sum("total")).first()[0]
    by_dep = reports.dept_summary(model).agg(F.sum("total")).first()[0]
    assert total == by_d == by_dep == model.complaints.count()


def test_bundle_equals_single_queries(model):
    bundle = reports.dashboard_bundle(model)
    singles = {"public_totals": reports.public_totals(model), "district_summary": reports.district_summary(model),
               "dept_summary": reports.dept_summary(model), "cm_totals": reports.cm_totals(model),
               "cm_by_district": reports.cm_by_district(model),
               "cm_by_department": reports.cm_by_department(model),
               "sla_performance": reports.sla_performance(model)}
    for name, single in singles.items():
        a = sorted(map(tuple, bundle[name].collect()))
        b = sorted(map(tuple, single.select(*bundle[name].columns).collect()))
        assert a == b, name


def test_complaint_numbers_unique_and_dense(model):
    seq = model.complaints.select(F.split("complaint_no", "-").getItem(3).cast("long").alias("n"))
    agg = seq.agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.count("*")).first()
    assert tuple(agg) == (1, agg[3], agg[3], agg[3])


def test_filing_accepted_plus_rejected_is_input(spark, model):
    req = adapter.filing_requests(spark, SF)
    res = intake.file_complaints(model, req, adapter.upload_requests(spark, SF))
    assert res.complaints.count() + res.rejects.count() == req.count()


def test_escalation_twice_equals_once(model):
    first = lifecycle.escalate_overdue(model)
    assert first.changed.count() > 0
    assert lifecycle.escalate_overdue(model.replace(complaints=first.snapshot)).changed.count() == 0


def test_vote_replay_adds_nothing(spark, model):
    req = adapter.vote_requests(spark, SF)
    res = votes.apply_upvotes(model, req)
    stored = model.upvotes.unionByName(res.accepted.select(F.col("vote_id").alias("id"), "complaint_id",
                                                          "voter_ip", F.col("ts").alias("voted_at")))
    again = votes.apply_upvotes(model.replace(upvotes=stored), req)
    assert again.accepted.count() == 0


def test_feed_pages_disjoint(model):
    p1 = {r["complaint_no"] for r in lookups.public_feed(model, page_no=1).collect()}
    p2 = {r["complaint_no"] for r in lookups.public_feed(model, page_no=2).collect()}
    assert len(p1) == 20 and len(p2) == 20 and not (p1 & p2)


# ------------------------------------------------------------------ plan shapes

def test_global_rank_has_no_single_task_window_over_rows(model):
    plan = model.complaints._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            # only the per-bucket count table is gathered into one task
            assert "HashAggregate" in lines[i + 1], plan


def test_window_group_limits_present(spark, model):
    res = votes.apply_upvotes(model, adapter.vote_requests(spark, SF))
    cross = votes.community_escalation(model, res)
    cross.collect()
    assert "WindowGroupLimit" in _plan(cross)
    q = lookups.officer_queue_all(model)
    q.collect()
    assert "WindowGroupLimit" in _plan(q)


def test_district_summary_aggregates_before_join(model):
    df = reports.district_summary(model)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the join with districts sees the per-district counts, never complaint rows
    assert "LeftOuter" in plan
    join_at = plan.index("LeftOuter")
    assert "HashAggregate" in plan[join_at:]


def test_scan_prunes_columns(model):
    df = reports.public_totals(model)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "text" not in plan.split("documents")[0]


def test_rate_limit_first_k_is_pruned(spark):
    from civiccases.operators import timing
    v = timing.rate_limit_verdicts(adapter.client_requests(spark, SF), timing.TEST_RATE_LIMITS)
    v.collect()
    assert "WindowGroupLimit" in _plan(v)


def test_deep_page_has_no_single_task_window_over_rows(model):
    df = lookups.public_feed(model, page_no=40)
    df.collect()
    lines = _plan(df).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line and "Exchange" in line:
            assert "HashAggregate" in lines[i + 1], "\n".join(lines)


def test_snapshot_layout_serves_filters(spark, model):
    from pyspark.sql import functions as F

    from civiccases.sources import sinks
    from civiccases.sources.model import load_model
    from civiccases.streaming.streams import run_dir

    out = sinks.write_snapshot(model, run_dir(spark, "test-snapshot"))
    back = load_model(spark, out, model.as_of)
    by_district = back.complaints.filter(F.col("district_id") == 3)
    assert "district_id,3" in _plan(by_district).replace(" ", "") or "EqualTo(district_id,3)" in _plan(by_district)
    by_year = spark.read.parquet(f"{out}/complaints").filter(F.col("created_year") == 1997)
    plan = _plan(by_year)
    assert "PartitionFilters: [isnotnull(created_year" in plan and "= 1997" in plan
    assert by_year.count() == model.complaints.filter(F.year("created_at") == 1997).count()


def test_dashboard_rows_cover_nine_sections_from_three_scans(model):
    rows = reports.dashboard_long(model).collect()
    assert {r["section"] for r in rows} == set(reports.dashboard_bundle(model))
    assert len({(r["section"], r["key"], r["metric"]) for r in rows}) == len(rows)
