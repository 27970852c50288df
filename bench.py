"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=3 python bench.py

1. Builds the complaints model from the testdata once and writes it as a
   snapshot (as production holds it), plus the request inputs of the jobs.
2. Times every headline query on that snapshot: full execution into the
   ``noop`` sink (nothing is collected), median of BENCH_RUNS runs after one
   warm-up.

Prints ONE JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from civiccases.functions.expr import overdue_at, pct  # noqa: E402
from civiccases.operators import intake, lifecycle, lookups, quality, reports, timing, votes  # noqa: E402
from civiccases.session import ensure_checkpoint_dir, get_spark, scratch_path  # noqa: E402
from civiccases.sources import adapter, sinks  # noqa: E402
from civiccases.sources.model import load_model  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    samples = []
    for i in range(RUNS + 1):
        t0 = time.perf_counter()
        out = make()
        if out is not None:
            run(out)
        if i:                                   # first run is the warm-up
            samples.append(time.perf_counter() - t0)
    return round(statistics.median(samples), 3)


def main() -> None:
    spark = get_spark(master=f"local[{CPUS}]", app="civiccases-bench", shuffle_partitions=CPUS * 2)
    ensure_checkpoint_dir(spark)
    # inputs and snapshot go under the shared checkpoint folder, never a machine-local temp dir
    work = scratch_path(spark, f"bench-{uuid.uuid4().hex[:12]}")

    t0 = time.perf_counter()
    raw = adapter.load_testdata_model(spark, SF_DIR)
    snap = sinks.write_snapshot(raw, f"{work}/snapshot")
    inputs = {
        "status_updates": adapter.status_updates(spark, SF_DIR),
        "filings": adapter.filing_requests(spark, SF_DIR),
        "uploads": adapter.upload_requests(spark, SF_DIR),
        "votes": adapter.vote_requests(spark, SF_DIR),
        "clients": adapter.client_requests(spark, SF_DIR),
        "codes": adapter.code_events(spark, SF_DIR),
    }
    for name, df in inputs.items():
        df.write.mode("overwrite").parquet(f"{work}/{name}")
    build_sec = round(time.perf_counter() - t0, 3)

    m = load_model(spark, snap, raw.as_of)
    req = {name: spark.read.parquet(f"{work}/{name}") for name in inputs}

    def bundle_run():
        run(reports.dashboard_long(m))

    headline = {
        "district_summary": lambda: reports.district_summary(m),
        "dept_summary": lambda: reports.dept_summary(m),
        "cm_totals": lambda: reports.cm_totals(m),
        "sla_performance": lambda: reports.sla_performance(m),
        "dashboard_bundle": bundle_run,
        "track_report": lambda: lookups.track_report(m),
        "timeline_history": lambda: lookups.timeline_history(m),
        "complaint_detail": lambda: lookups.complaint_detail(m),
        "officer_queue": lambda: lookups.officer_queue(m, role="officer", dept=3),
        "officer_queue_all": lambda: lookups.officer_queue_all(m),
        "public_feed_page2": lambda: lookups.public_feed(m, page_no=2),
        "recent_activity": lambda: lookups.recent_activity(m),
        "case_file": lambda: lookups.case_file_summary(m),
        "file_complaints": lambda: intake.file_complaints(m, req["filings"], req["uploads"]).complaints,
        "apply_status_updates": lambda: lifecycle.apply_status_updates(m, req["status_updates"]).changed,
        "status_change_log": lambda: lifecycle.apply_status_updates(m, req["status_updates"]).timeline.where(
            "origin = 'trigger'"),
        "escalate_overdue": lambda: lifecycle.escalate_overdue(m).snapshot,
        "apply_upvotes": lambda: votes.apply_upvotes(m, req["votes"]).counts,
        "community_escalation": lambda: votes.community_escalation(m, votes.apply_upvotes(m, req["votes"])),
        "constraint_audit": lambda: quality.constraint_audit(m),
        "rate_limit_verdicts": lambda: timing.rate_limit_verdicts(req["clients"], timing.TEST_RATE_LIMITS),
        "code_verification": lambda: timing.code_verification(req["codes"], adapter.TEST_CODE_TTL_SECONDS),
        "rolling_activity_7d": lambda: timing.rolling_activity(m),
    }
    results = {name: timed(make) for name, make in headline.items()}

    def literal_district_summary():
        c = m.complaints
        d = m.districts
        per = (d.join(c, c["district_id"] == d["id"], "left").groupBy(d["id"], d["name"], d["code"])
               .agg(F.count(c["id"]).alias("total"), F.count_if(c["status"] == "resolved").alias("resolved"),
                    F.count_if(c["status"] == "in_progress").alias("in_progress"),
                    F.count_if(overdue_at(m.as_of)).alias("overdue")))
        return (per.withColumn("resolution_pct", pct(F.col("resolved"), F.col("total")))
                .orderBy(F.desc("total"), "id"))

    def nine_queries():
        for report in (reports.public_totals, reports.district_summary, reports.dept_summary, reports.cm_totals,
                       reports.cm_by_district, reports.cm_by_department, reports.sla_performance,
                       lookups.recent_activity, lookups.top_issues):
            run(report(m))

    def single_window_numbers():
        return m.complaints.withColumn("seq", F.row_number().over(Window.orderBy("created_at", "id")))

    def two_level_numbers():
        from civiccases.plans.ranking import bucket_of, global_rank
        return global_rank(m.complaints, bucket_of("created_at", "day"), ["created_at", "id"], "seq")

    def unpruned_crossing():
        res = votes.apply_upvotes(m, req["votes"])
        w = Window.partitionBy("complaint_id").orderBy("ts", "vote_id")
        base = m.complaints.where("priority = 'normal'").select(
            F.col("id").alias("_id"), F.coalesce("upvote_count", F.lit(0)).alias("base"))
        r = res.accepted.withColumn("rn", F.row_number().over(w)).join(base, F.col("complaint_id") == F.col("_id"))
        return r.filter(F.col("rn") == F.greatest(F.lit(1), F.lit(10) - F.col("base")))

    pairs = {
        "A02_aggregate_first": results["district_summary"],
        "A02_literal_outer_join": timed(literal_district_summary),
        "A09_one_scan_bundle": results["dashboard_bundle"],
        "A09_separate_queries": timed(nine_queries),
        "J03_two_level_rank": timed(two_level_numbers),
        "J03_single_window": timed(single_window_numbers),
        "J17_pruned": results["community_escalation"],
        "J17_unpruned": timed(unpruned_crossing),
    }
    total = round(sum(results.values()), 3)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": results, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "snapshot_build_sec": build_sec, "pairs": pairs, "runs": RUNS, "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
