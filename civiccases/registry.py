"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry runs one operator of SURVEY section 2 over the whole testdata
model at ``sf_dir``; the matching DuckDB statement is in
``civiccases.oracle.queries_sql`` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiccases.operators import intake, lifecycle, lookups, quality, reports, timing, votes
from civiccases.sources import adapter
from civiccases.streaming import streams
from civiccases.sources import sinks
from civiccases.sources.model import TABLES, load_model, seed_departments
from civiccases.sources.scratch import Scratch

#: buckets of the versioned tables; the streams' default suits a table of a billion rows
FIXTURE_BUCKETS = 16
Query = Callable[[SparkSession, str], DataFrame]


def _model(spark: SparkSession, sf_dir: str):
    return adapter.load_testdata_model(spark, sf_dir)


def _with_model(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_model(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def load_model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01 check: row count of every model table (one scan each)."""
    m = _model(spark, sf_dir)
    out = None
    for name in TABLES:
        one = getattr(m, name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def _upvote_pairs(spark, sf_dir):
    m = _model(spark, sf_dir)
    return lookups.upvote_status(m, adapter.vote_requests(spark, sf_dir))


def _filing(spark, sf_dir):
    m = _model(spark, sf_dir)
    return m, intake.file_complaints(m, adapter.filing_requests(spark, sf_dir),
                                     adapter.upload_requests(spark, sf_dir))


def _status(spark, sf_dir):
    m = _model(spark, sf_dir)
    return m, lifecycle.apply_status_updates(m, adapter.status_updates(spark, sf_dir))


def _status_log(spark, sf_dir):
    """J-14: the lines, the updates made of them and the checked updates are stored in turn, each until the next one is."""
    lines, asked, checked = (Scratch(spark, f"status-{part}") for part in ("lines", "updates", "checked"))
    updates = asked.keep(adapter.status_updates(spark, sf_dir, lines.keep))
    lines.drop()
    res = lifecycle.apply_status_updates(_model(spark, sf_dir), updates, keep_log=checked.keep)
    asked.drop()
    return res.timeline.filter(F.col("origin") == "trigger")


def _votes(spark, sf_dir):
    m = _model(spark, sf_dir)
    return m, votes.apply_upvotes(m, adapter.vote_requests(spark, sf_dir))


def _notifications(spark, sf_dir):
    m = _model(spark, sf_dir)
    filings = intake.file_complaints(m, adapter.filing_requests(spark, sf_dir), adapter.upload_requests(spark, sf_dir))
    status = lifecycle.apply_status_updates(m, adapter.status_updates(spark, sf_dir))
    events = lifecycle.notification_events(m, filings=filings, status=status, escalation=True)
    registered = intake.register_citizens(m, adapter.registration_requests(spark, sf_dir))
    return lifecycle.compose_messages(m, events).unionByName(lifecycle.welcome_messages(registered))


def _purge(spark, sf_dir):
    m = _model(spark, sf_dir)
    rejected = m.complaints.filter(F.col("status") == "rejected").select("id")
    return quality.cascade_purge(m, rejected)


def _stream_rate(spark, sf_dir):
    root = streams.run_dir(spark, "rate-limits")
    src, schema = streams.staged(spark, adapter.client_requests(spark, sf_dir), "ts", root)
    return streams.rate_limit_stream(spark, src, schema, timing.TEST_RATE_LIMITS, root)


def _stream_codes(spark, sf_dir):
    root = streams.run_dir(spark, "codes")
    src, schema = streams.staged(spark, adapter.code_events(spark, sf_dir), "ts", root)
    return streams.code_verification_stream(spark, src, schema, root, adapter.TEST_CODE_TTL_SECONDS)


def _stream_rolling(spark, sf_dir):
    root = streams.run_dir(spark, "rolling")
    m = _model(spark, sf_dir)
    src, schema = streams.staged(spark, m.complaints.select("id", "created_at"), "created_at", root)
    return streams.rolling_activity_stream(spark, src, schema, root)


def _stream_votes(spark, sf_dir):
    root = streams.run_dir(spark, "votes")
    m = _model(spark, sf_dir)
    src, schema = streams.staged(spark, adapter.vote_requests(spark, sf_dir), "ts", root)
    return streams.upvote_stream(spark, m, src, schema, root)


def _stream_vote_counts(spark, sf_dir):
    v = _stream_votes(spark, sf_dir)
    return (v.filter(F.col("kind") == "count").groupBy("complaint_id")
             .agg(F.sum("new_votes").alias("new_votes"), F.max("upvote_count").alias("upvote_count"))
             .filter(F.col("new_votes") > 0))


def _stream_vote_crossings(spark, sf_dir):
    return _stream_votes(spark, sf_dir).filter(F.col("kind") == "crossed").select("complaint_id", "vote_id", "upvote_count")


def _stream_vote_rejects(spark, sf_dir):
    return _stream_votes(spark, sf_dir).filter(F.col("kind") == "reject").select("vote_id", "reason")


def _run_intake_stream(spark, sf_dir) -> str:
    root = streams.run_dir(spark, "intake")
    m = _model(spark, sf_dir)
    src, schema = streams.staged(spark, adapter.filing_requests(spark, sf_dir), "ts", root)
    streams.intake_stream(spark, m, src, schema, adapter.upload_requests(spark, sf_dir), root)
    return root


def _stream_intake(spark, sf_dir):
    return streams.intake_output(spark, _run_intake_stream(spark, sf_dir), "complaints").drop("description")


def _stream_intake_output(name: str) -> Query:
    return lambda spark, sf_dir: streams.intake_output(spark, _run_intake_stream(spark, sf_dir), name)


def _case_files(spark, sf_dir):
    """Q-10 for the emergencies of one department, as sizes and ends of the nested arrays."""
    m = _model(spark, sf_dir)
    ids = m.complaints.filter("department_id = 3 and priority = 'emergency'").select("id")
    files, steps = F.col("attachments"), F.col("timeline")
    return lookups.case_file(m, ids).select(
        "complaint.id", "complaint.complaint_no", F.size(files).cast("long").alias("n_attachments"),
        F.try_element_at(files, F.lit(1))["file_url"].alias("first_file"),
        F.try_element_at(files, F.lit(-1))["file_url"].alias("last_file"),
        F.size(steps).cast("long").alias("n_timeline"),
        F.try_element_at(steps, F.lit(1))["status"].alias("first_status"),
        F.try_element_at(steps, F.lit(-1))["status"].alias("last_status"),
        F.size(F.filter(steps, lambda s: s["updated_by"].isNotNull())).cast("long").alias("n_by_officers"))


def _stream_status(spark, sf_dir):
    root = streams.run_dir(spark, "status")
    m = _model(spark, sf_dir)
    lines = Scratch(spark, "status-lines")
    src, schema = streams.staged(spark, adapter.status_updates(spark, sf_dir, lines.keep), "ts", root)
    lines.drop()
    return streams.status_stream(spark, m, src, schema, root, buckets=FIXTURE_BUCKETS)


def _stream_escalation(spark, sf_dir):
    from datetime import timedelta
    root = streams.run_dir(spark, "escalation")
    m = _model(spark, sf_dir)
    return streams.escalation_schedule(spark, m, [m.as_of, m.as_of + timedelta(days=1)], root, FIXTURE_BUCKETS)


def _snapshot_round_trip(spark, sf_dir):
    """SNK-01 + SRC-01: write the snapshot, load it back typed, count every table."""
    m = _model(spark, sf_dir)
    out = sinks.write_snapshot(m, streams.run_dir(spark, "snapshot"))
    back = load_model(spark, out, m.as_of)
    parts = [getattr(back, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
             for t in TABLES]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def _outbox_replay(spark, sf_dir):
    """SNK-02: the filing outbox appended as batch 0, then batch 0 replayed: no duplicates."""
    m, res = _filing(spark, sf_dir)
    path = streams.run_dir(spark, "outbox")
    sinks.append_outbox(res.outbox, path, batch_id=0)
    sinks.append_outbox(res.outbox, path, batch_id=0)
    return spark.read.parquet(path).drop("batch_id")


def _bundle(spark, sf_dir):
    m = _model(spark, sf_dir)
    return reports.dashboard_long(m)


QUERIES: dict[str, Query] = {
    # sources
    "load_model": load_model_counts,
    "seed_departments": lambda spark, sf_dir: lookups.seed_usage(_model(spark, sf_dir), seed_departments(spark)),
    "write_snapshot": _snapshot_round_trip,
    "append_outbox": _outbox_replay,
    # lookups
    "districts_list": _with_model(lookups.districts_list),
    "mandals_by_district": _with_model(lookups.mandals_by_district),
    "active_departments": _with_model(lookups.active_departments),
    "track_report": _with_model(lookups.track_report),
    "timeline_history": _with_model(lookups.timeline_history),
    "citizen_complaints": _with_model(lookups.citizen_complaints),
    "officer_queue": _with_model(lambda m: lookups.officer_queue(m, role="officer", dept=3)),
    "officer_queue_page3": _with_model(
        lambda m: lookups.officer_queue(m, role="admin", status="in_progress", page_no=3)),
    "officer_queue_all": _with_model(lookups.officer_queue_all),
    "complaint_detail": _with_model(lookups.complaint_detail),
    "attachment_manifest": _with_model(lookups.attachment_manifest),
    "case_file": _with_model(lookups.case_file_summary),
    "case_file_nested": _case_files,
    "public_feed": _with_model(lookups.public_feed),
    "public_feed_page2": _with_model(lambda m: lookups.public_feed(m, district_id=3, page_no=2)),
    "public_feed_deep_page": _with_model(lambda m: lookups.public_feed(m, page_no=150)),
    "officer_queue_deep_page": _with_model(lambda m: lookups.officer_queue(m, role="admin", page_no=400)),
    "recent_activity": _with_model(lookups.recent_activity),
    "top_issues": _with_model(lookups.top_issues),
    "upvote_status": _upvote_pairs,
    "contact_lookup": _with_model(lookups.contact_lookup),
    "contact_by_phone": lambda spark, sf_dir: lookups.contact_by_phone(
        _model(spark, sf_dir), adapter.registration_requests(spark, sf_dir).select("phone")),
    "contact_by_id": lambda spark, sf_dir: lookups.contact_by_id(
        _model(spark, sf_dir), adapter.filing_requests(spark, sf_dir).select("caller_id")),
    # aggregates
    "public_totals": _with_model(reports.public_totals),
    "district_summary": _with_model(reports.district_summary),
    "dept_summary": _with_model(reports.dept_summary),
    "officer_dashboard": _with_model(reports.officer_dashboard),
    "cm_totals": _with_model(reports.cm_totals),
    "cm_by_district": _with_model(reports.cm_by_district),
    "cm_by_department": _with_model(reports.cm_by_department),
    "sla_performance": _with_model(reports.sla_performance),
    "dashboard_bundle": _bundle,
    # intake
    "intake_validate": lambda spark, sf_dir: intake.intake_validate(
        adapter.filing_requests(spark, sf_dir)).select("request_id", "reason"),
    "resolve_reference": lambda spark, sf_dir: intake.resolve_reference(
        _model(spark, sf_dir), adapter.filing_requests(spark, sf_dir)).select(
            "request_id", "district_code", "sla_days", "ref_reason"),
    "assign_complaint_no": lambda spark, sf_dir: _filing(spark, sf_dir)[1].complaints.select(
        F.col("id").alias("request_id"), "complaint_no"),
    "sla_deadline": lambda spark, sf_dir: _filing(spark, sf_dir)[1].complaints.select(
        "id", "created_at", "sla_deadline"),
    "hash_identity": lambda spark, sf_dir: _filing(spark, sf_dir)[1].citizen_updates,
    "anonymise": lambda spark, sf_dir: _filing(spark, sf_dir)[1].complaints.select(
        "id", "citizen_id", "is_anonymous"),
    "defaults_and_visibility": lambda spark, sf_dir: _filing(spark, sf_dir)[1].complaints.select(
        "id", "priority", "source", "latitude", "longitude", "address", "is_public"),
    "attachment_classify": lambda spark, sf_dir: intake.attachment_classify(adapter.upload_requests(spark, sf_dir)),
    "initial_timeline": lambda spark, sf_dir: _filing(spark, sf_dir)[1].timeline,
    "file_complaints": lambda spark, sf_dir: _filing(spark, sf_dir)[1].complaints.drop("description"),
    "filing_rejects": lambda spark, sf_dir: _filing(spark, sf_dir)[1].rejects,
    "filing_outbox": lambda spark, sf_dir: _filing(spark, sf_dir)[1].outbox,
    "filing_attachments": lambda spark, sf_dir: _filing(spark, sf_dir)[1].attachments,
    "register_citizens": lambda spark, sf_dir: intake.register_citizens(
        _model(spark, sf_dir), adapter.registration_requests(spark, sf_dir)),
    # lifecycle
    "overdue_flag": _with_model(lifecycle.overdue_flag),
    "apply_status_updates": lambda spark, sf_dir: _status(spark, sf_dir)[1].changed,
    "status_update_rejects": lambda spark, sf_dir: _status(spark, sf_dir)[1].rejects,
    "status_change_log": _status_log,
    "escalate_overdue": _with_model(lambda m: lifecycle.escalate_overdue(m).changed),
    "escalation_messages": _with_model(lambda m: lifecycle.escalate_overdue(m).messages),
    "apply_upvotes": lambda spark, sf_dir: _votes(spark, sf_dir)[1].counts,
    "upvote_rejects": lambda spark, sf_dir: _votes(spark, sf_dir)[1].rejects,
    "community_escalation": lambda spark, sf_dir: votes.community_escalation(*_votes(spark, sf_dir)),
    "compose_notifications": _notifications,
    "last_seen": lambda spark, sf_dir: lifecycle.last_seen(_model(spark, sf_dir), adapter.logins(spark, sf_dir)),
    # quality
    "constraint_audit": _with_model(quality.constraint_audit),
    "cascade_purge": _purge,
    # time rules (batch twins of the streams)
    "rate_limit_verdicts": lambda spark, sf_dir: timing.rate_limit_verdicts(
        adapter.client_requests(spark, sf_dir), timing.TEST_RATE_LIMITS),
    "rate_limit_violators": lambda spark, sf_dir: timing.rate_limit_violators(
        adapter.client_requests(spark, sf_dir), timing.TEST_RATE_LIMITS),
    "code_verification": lambda spark, sf_dir: timing.code_verification(
        adapter.code_events(spark, sf_dir), adapter.TEST_CODE_TTL_SECONDS),
    "rolling_activity_7d": _with_model(timing.rolling_activity),
    "rolling_activity_24h": _with_model(lambda m: timing.rolling_activity(m, "24 hours", "1 hour")),
    # streams (each runs to completion with availableNow and returns its committed output)
    "stream_rate_limit_violators": _stream_rate,
    "stream_code_verification": _stream_codes,
    "stream_rolling_activity_7d": _stream_rolling,
    "stream_upvote_counts": _stream_vote_counts,
    "stream_community_escalation": _stream_vote_crossings,
    "stream_upvote_rejects": _stream_vote_rejects,
    "stream_intake": _stream_intake,
    "stream_intake_timeline": _stream_intake_output("timeline"),
    "stream_intake_attachments": _stream_intake_output("attachments"),
    "stream_intake_identity": _stream_intake_output("citizen_updates"),
    "stream_intake_rejects": _stream_intake_output("rejects"),
    "stream_status_changes": _stream_status,
    "stream_escalation": _stream_escalation,
}


def _in_utc(fn: Query) -> Query:
    """Fixture timestamps are timestamp_ntz; elapsed-time and window arithmetic on them
    goes through the session zone, so every registered query runs with the zone pinned
    to UTC (no DST gaps inside the fixture's day counts)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


QUERIES = {name: _in_utc(fn) for name, fn in QUERIES.items()}

