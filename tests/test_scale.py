"""What large tables must not do: move texts through joins, compute inputs again, gather large sides in the driver."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from civiccases.operators import intake, lifecycle, lookups, quality
from civiccases.plans import slices
from civiccases.plans.ranking import bucket_of, global_rank
from civiccases.plans.sequences import bucketed_lag
from civiccases.session import scratch_path
from civiccases.sources import adapter
from civiccases.streaming import streams
from helpers import AS_OF, complaint, make_model

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_joined_last(spark):
    """No window, and in the detail report no other join, holds the descriptions."""
    m = adapter.load_testdata_model(spark, SF)
    whole = _plan(m.complaints)
    assert "text#" in whole[:whole.index("Window")] and "text#" not in whole[whole.index("Window"):whole.rindex("Window")]
    joins = [line for line in _plan(lookups.complaint_detail(m)).splitlines() if " Join " in line or line.startswith("Join ")]
    assert "doc_id#" in joins[0] and not any("doc_id#" in line for line in joins[1:])
    assert "described" not in m.replace(complaints=m.complaints.limit(3)).extra


def test_a_queue_page_reads_no_description(spark, monkeypatch):
    seen = []
    page = lookups.page
    monkeypatch.setattr(lookups, "page", lambda df, *rest: seen.append(df) or page(df, *rest))
    m = make_model(spark, complaints=[complaint(id=i) for i in range(1, 4)])
    assert lookups.officer_queue(m, role="admin").count() == 3
    assert "description" not in seen[0].columns


def test_escalation_stores_what_it_changes(spark):
    """The state has no texts; the full table still shows each pass, row by row where rows share an id."""
    old, soon = AS_OF - timedelta(days=1), AS_OF + timedelta(hours=1)
    m = make_model(spark, complaints=[complaint(id=1, sla_deadline=old, description="one"),
                                      complaint(id=1, sla_deadline=soon, description="two"),
                                      complaint(id=2, sla_deadline=old, status="resolved"), complaint(id=3)])
    root = streams.run_dir(spark, "test-escalation")
    runs = [AS_OF, AS_OF + timedelta(days=1)]
    streams.escalation_schedule(spark, m, runs, root, 4)
    stored = streams.escalation_versions(spark, m, root, 4)
    files = spark.read.parquet(*stored.read(stored.latest()).inputFiles())
    assert "description" not in files.columns
    after = streams.escalated_snapshot(spark, m, root, 4)
    got = sorted((r["id"], r["description"], r["is_overdue"], r["updated_at"]) for r in after.collect())
    first = datetime(2024, 3, 1)
    assert got == [(1, "one", True, runs[0]), (1, "two", True, runs[1]), (2, "d", False, first), (3, "d", False, first)]
    assert after.columns == m.complaints.columns


def test_landed_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    df = spark.range(300).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    path = streams.stage_in_time_order(df.mapInPandas(watch, df.schema), "ts", streams.run_dir(spark, "test-once") + "/landing", 3)
    assert spark.read.parquet(path).count() == 300 and seen.value == 300


def test_citizens_are_not_gathered(spark):
    """The check of callers merges the citizens; no estimate lets them be broadcast."""
    m = adapter.load_testdata_model(spark, SF)
    rejects = intake.file_complaints(m, adapter.filing_requests(spark, SF)).rejects
    plan = rejects._jdf.queryExecution().executedPlan().toString()
    anti = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert anti and all("SortMergeJoin" in line for line in anti)
    kept = []
    res = intake.file_complaints(m, adapter.filing_requests(spark, SF), keep=lambda rows: kept.append(rows) or rows)
    assert len(kept) == 2 and "reject_reason" in kept[0].columns and "complaint_no" in kept[1].columns
    assert res.rejects.count() == rejects.count()


def test_audit_deals_its_keys_by_their_number(spark, monkeypatch):
    """As many parts as the keys need, no count of unique keys before the shuffle; hot and rare keys, chunk by chunk."""
    rows = [complaint(id=i % 390, department_id=3 if i % 10 else i, is_anonymous=i % 390 == 7) for i in range(400)]
    notes = [dict(id=i, complaint_id=7 if i % 4 else 10_000 + i, citizen_id=1 if i % 3 else None, channel="sms", message="m")
             for i in range(600)]
    votes = [dict(id=i, complaint_id=None if i % 5 == 0 else 1, voter_ip=None if i % 7 == 0 else f"v{i % 50}") for i in range(100)]
    m = make_model(spark, complaints=rows, notifications=notes, upvotes=votes)
    whole = sorted(quality.constraint_audit(m).collect())
    got = {r[:3]: r["n_violations"] for r in whole}
    assert got["complaints", "unique", "id"] == 10
    assert got["complaints", "foreign_key:departments", "department_id"] == sum(i > 10 or i == 0 for i in range(0, 400, 10))
    assert got["notifications", "foreign_key:complaints", "complaint_id"] == 150
    assert got["notifications", "anonymity_leak", "citizen_id"] == sum(1 for i in range(600) if i % 4 and i % 3)
    pairs = [(1, f"v{i % 50}") for i in range(100) if i % 5 and i % 7]
    assert got["upvotes", "unique", "complaint_id,voter_ip"] == sum(pairs.count(p) > 1 for p in set(pairs))

    monkeypatch.setattr(quality, "TASK_KEYS", 100)
    monkeypatch.setattr(quality, "CHUNK_ROWS", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert sorted(quality.constraint_audit(m).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = quality.constraint_audit(m)._jdf.queryExecution().executedPlan().toString()
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning(space#" in line and "number#" in line]
    most = 400 * 7 + 600 * 4 + 100 + sum(2 * getattr(m, t).count() for t in ("districts", "departments"))
    assert len(deals) == 1 and int(deals[0].split(", REPARTITION")[0].rsplit(", ", 1)[1].rstrip(")")) >= most // 100
    below = plan[plan.index(deals[0]) + len(deals[0]):plan.index("MapInArrow")]
    assert "Aggregate" not in below


def test_numbered_rows_are_dealt_by_their_number(spark, monkeypatch):
    """The same numbers from more tasks than the session's; nothing is dealt where the number is not read."""
    df = spark.range(3000).select(F.col("id"), F.timestamp_seconds(F.col("id") * 977 % 90_000).cast("timestamp_ntz").alias("ts"))
    plain = global_rank(df, bucket_of("ts"), ["ts", "id"], "n")
    monkeypatch.setattr(slices, "PART_ROWS", 100)
    dealt = global_rank(df, bucket_of("ts"), ["ts", "id"], "n", n_rows=3000)
    assert sorted(dealt.collect()) == sorted(plain.collect())
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "hashpartitioning(_bucket" in line and ", 30)" in line]
    assert "Repartition" not in _plan(dealt.select("id", "ts"))


def test_the_adapters_large_joins_follow_their_rows(spark, monkeypatch):
    """Timeline, notifications and complaints are the same rows when they are dealt into many parts."""
    def all_rows():
        m = adapter.load_testdata_model(spark, SF)
        return [sorted(map(str, getattr(m, t).collect())) for t in ("complaints", "timeline", "notifications")], m
    plain, m = all_rows()
    assert [m.rows(t) >= len(rows) > 0 for t, rows in zip(("complaints", "timeline", "notifications"), plain)] == [True] * 3
    assert m.replace(timeline=m.timeline.limit(3)).rows("timeline") == 3
    monkeypatch.setattr(slices, "PART_ROWS", 100)
    dealt, m = all_rows()
    assert dealt == plain
    assert "RepartitionByExpression [o_orderkey" in _plan(m.timeline) and "RepartitionByExpression [o_orderkey" in _plan(m.notifications)


def _shuffled(df) -> int:
    """Rows that the exchanges of a plan wrote when it ran."""
    df.collect()
    nodes, found, seen = [df._jdf.queryExecution().executedPlan()], 0, set()
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
        elif name != "ReusedExchange":
            if name == "Exchange" and node.id() not in seen:
                found += node.metrics().apply("shuffleRecordsWritten").value()
                seen.add(node.id())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_a_lag_shuffles_its_rows_once(spark):
    """Updates nearly one a (complaint, day): no count, last value or carry of each of these is shuffled."""
    df = spark.range(4000).select("id", (F.col("id") % 200).alias("k"), (F.col("id") % 3).cast("string").alias("v"),
                                  F.timestamp_seconds(F.col("id") * 30_000).cast("timestamp_ntz").alias("ts"))
    got = bucketed_lag(df, "k", F.date_trunc("day", "ts"), ["ts", "id"], "v", "prev", F.lit("base"))
    assert 4000 <= _shuffled(got) <= 4000 + 2 * 8 * 200
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.withColumn("prev", F.when(F.row_number().over(w) == 1, F.lit("base")).otherwise(F.lag("v").over(w)))
    assert sorted(got.select("id", "prev").collect()) == sorted(want.select("id", "prev").collect())


@pytest.mark.parametrize("busiest", [1, 2, 100])
def test_only_busy_keys_are_cut(spark, monkeypatch, busiest):
    """Keys of all sizes, null ones and null times among them; those past the largest ones looked at are one cell."""
    monkeypatch.setattr(slices, "MAX_BUSY", busiest)
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 != 0, F.floor(F.sqrt(F.col("id") % 50))).alias("k"),
                                  (F.col("id") % 3).cast("string").alias("v"),
                                  F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.col("id") * 977 % 400_000))
                                   .cast("timestamp_ntz").alias("ts"))
    got = bucketed_lag(df, "k", F.date_trunc("day", "ts"), ["ts", "id"], "v", "prev", F.lit("base"), slice_rows=100)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.withColumn("prev", F.when(F.row_number().over(w) == 1, F.lit("base")).otherwise(F.lag("v").over(w)))
    assert sorted(got.select("id", "prev").collect()) == sorted(want.select("id", "prev").collect())


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_the_change_log_keeps_only_what_it_reads(spark):
    """When the query is there, no shuffle file of its making is, and one table: the checked updates it reads."""
    from civiccases.registry import QUERIES
    kept = Path(scratch_path(spark, "kept"))
    had, before = {*kept.glob("*")}, _shuffle_files(spark)
    log = QUERIES["status_change_log"](spark, SF)
    assert _shuffle_files(spark) <= before
    assert [p.name.rsplit("-", 1)[0] for p in {*kept.glob("*")} - had] == ["status-checked"]
    m, updates = adapter.load_testdata_model(spark, SF), adapter.status_updates(spark, SF)
    want = lifecycle.apply_status_updates(m, updates).timeline.where("origin = 'trigger'")
    assert sorted(map(str, log.collect())) == sorted(map(str, want.collect()))


def test_the_status_stream_leaves_its_outputs_only(spark):
    """No shuffle files of its commands, no second copy of the landed rows, none of the checked updates; same rows as the batch."""
    from civiccases.registry import QUERIES
    runs, kept = Path(scratch_path(spark, "streams")), Path(scratch_path(spark, "kept"))
    had, before = {*runs.glob("status-*")} | {*kept.glob("*")}, _shuffle_files(spark)
    got = QUERIES["stream_status_changes"](spark, SF)
    assert _shuffle_files(spark) <= before and not {*kept.glob("*")} - had
    (root,) = {*runs.glob("status-*")} - had
    assert not [p for p in root.rglob("*.parquet") if p.relative_to(root).parts[0] not in ("landing", "out")]
    want = QUERIES["apply_status_updates"](spark, SF)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    log = spark.read.parquet(f"{root}/out/timeline").where("origin = 'trigger'")
    assert log.count() == QUERIES["status_change_log"](spark, SF).count()


def test_a_repeated_batch_replaces_what_it_kept(spark, tmp_path):
    from civiccases.sources.scratch import Scratch
    for n in (5, 3):
        again = Scratch(spark, "batch_id=0", str(tmp_path))
        assert again.keep(spark.range(n)).count() == n
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "batch_id=0" / "0")).collect()) == [0, 1, 2]
    again.drop()
    again.drop()
    assert not [*tmp_path.iterdir()]
