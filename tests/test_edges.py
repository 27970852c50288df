"""Hand-made edge rows (FIXTURES.md section 4) on a tiny in-memory model."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from civiccases.operators import intake, lifecycle, lookups, quality, reports, timing, votes
from helpers import AS_OF, complaint, make_model

D = datetime


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_overdue_three_valued_and_strict(spark):
    m = make_model(spark, complaints=[
        complaint(id=1, sla_deadline=None, status="submitted"),          # NULL deadline, active -> NULL
        complaint(id=2, sla_deadline=AS_OF, status="submitted"),         # exactly at as_of -> false
        complaint(id=3, sla_deadline=AS_OF - timedelta(seconds=1)),      # past -> true
        complaint(id=4, sla_deadline=AS_OF - timedelta(days=3), status="resolved"),
        complaint(id=5, sla_deadline=None, status="closed"),             # finished, NULL deadline -> false
    ])
    got = dict(rows(lifecycle.overdue_flag(m), "id", "is_overdue"))
    assert got == {1: None, 2: False, 3: True, 4: False, 5: False}


def test_empty_district_and_percentages(spark):
    m = make_model(spark, complaints=[
        complaint(id=1, district_id=1, status="resolved"), complaint(id=2, district_id=1),
        complaint(id=3, district_id=1), complaint(id=4, district_id=2, status="resolved")])
    got = {r["district_code"]: (r["total"], r["resolved"], r["resolution_pct"])
           for r in reports.district_summary(m).collect()}
    assert got == {"D01": (3, 1, 33.3), "D02": (1, 1, 100.0), "D03": (0, 0, None)}


def test_inactive_department_only_in_some_reports(spark):
    deps = [dict(id=i, name=f"d{i}", code=f"C{i}", sla_days=7, is_active=i != 9) for i in range(1, 11)]
    m = make_model(spark, complaints=[complaint(id=1, department_id=9)], departments=deps)
    assert 9 in {r["department_id"] for r in reports.dept_summary(m).collect()}
    assert 9 not in {r["department_id"] for r in reports.cm_by_department(m).collect()}
    perf = reports.sla_performance(m).collect()
    assert [r["department_id"] for r in perf] == [9]          # only departments with complaints


def test_window_boundaries(spark):
    m = make_model(spark, complaints=[
        complaint(id=1, created_at=AS_OF - timedelta(days=7)),
        complaint(id=2, created_at=AS_OF - timedelta(days=14)),
        complaint(id=3, created_at=AS_OF - timedelta(hours=24)),
        complaint(id=4, created_at=AS_OF - timedelta(days=7, microseconds=1)),
        complaint(id=5, status="resolved", created_at=AS_OF - timedelta(days=20),
                  resolved_at=AS_OF - timedelta(days=7)),
    ])
    t = reports.cm_totals(m).first()
    assert t["last_7_days"] == 2            # ids 1, 3
    assert t["last_24_hours"] == 1          # id 3
    assert t["prev_7_days"] == 2            # ids 2, 4
    assert t["resolved_this_week"] == 1
    assert t["avg_resolution_days"] == 13.0


def test_average_merges_sums_not_averages(spark):
    base = D(2024, 1, 1)
    m = make_model(spark, complaints=[
        complaint(id=1, district_id=1, status="resolved", created_at=base, resolved_at=base + timedelta(days=1)),
        complaint(id=2, district_id=2, status="resolved", created_at=base, resolved_at=base + timedelta(days=2)),
        complaint(id=3, district_id=2, status="resolved", created_at=base, resolved_at=base + timedelta(days=6)),
    ])
    bundle = reports.dashboard_bundle(m)
    assert bundle["cm_totals"].first()["avg_resolution_days"] == 3.0     # (1+2+6)/3, not (1+4)/2


def test_queue_order_nulls_first_and_enum_priority(spark):
    past = AS_OF - timedelta(days=1)
    m = make_model(spark, complaints=[
        complaint(id=1, priority="normal", sla_deadline=past),
        complaint(id=2, priority="emergency", sla_deadline=None),       # overdue NULL -> first
        complaint(id=3, priority="high", sla_deadline=past),
        complaint(id=4, priority="urgent", sla_deadline=past),
        complaint(id=5, priority="urgent", sla_deadline=AS_OF + timedelta(days=1)),
    ])
    got = [r["id"] for r in lookups.officer_queue(m, role="admin").collect()]
    assert got == [2, 4, 3, 1, 5]


def test_paging_disjoint_and_covering(spark):
    m = make_model(spark, complaints=[complaint(id=i, created_at=D(2024, 1, 1) + timedelta(hours=i % 3))
                                      for i in range(1, 46)])
    p = [set(r["id"] for r in lookups.officer_queue(m, role="admin", page_no=k, page_size=20).collect())
         for k in (1, 2, 3)]
    assert [len(x) for x in p] == [20, 20, 5]
    assert not (p[0] & p[1]) and not (p[1] & p[2])
    assert set.union(*p) == set(range(1, 46))


def test_status_updates_order_reopen_same_status(spark):
    m = make_model(spark, complaints=[complaint(id=1, status="submitted", assigned_to=7),
                                      complaint(id=2, status="assigned")],
                   officers=[dict(id=5, name="o", email="o@example.org")])
    t = D(2024, 3, 2)
    upd = spark.createDataFrame([
        (1, 1, "resolved", None, 5, t),
        (2, 1, "in_progress", None, 5, t + timedelta(hours=1)),
        (3, 1, "resolved", "again", 5, t + timedelta(hours=2)),
        (4, 2, "assigned", None, 5, t),                      # same status: handler row, no trigger row
        (5, 2, "closed", None, 5, t),                        # not settable
        (6, 99, "resolved", None, 5, t),                     # unknown complaint
        (9, 1, "rejected", None, 55, t + timedelta(hours=9)),      # unknown officer
        (8, 2, "in_progress", None, 5, t + timedelta(hours=3)),
        (7, 2, "acknowledged", None, 5, t + timedelta(hours=3)),   # same ts: update_id decides
    ], "update_id long, complaint_id long, status string, note string, officer_id int, ts timestamp_ntz")
    res = lifecycle.apply_status_updates(m, upd)
    changed = {r["id"]: (r["status"], r["resolved_at"]) for r in res.changed.collect()}
    assert changed[1] == ("resolved", t + timedelta(hours=2))
    assert changed[2] == ("in_progress", None)
    assert dict(rows(res.rejects, "update_id", "reason")) == {5: "Invalid status", 6: "Complaint not found",
                                                                9: "Unknown officer"}
    trig = rows(res.timeline.filter(F.col("origin") == "trigger"), "update_id", "status", "updated_by")
    assert trig == [(1, "resolved", 7), (2, "in_progress", 7), (3, "resolved", 7), (7, "acknowledged", None),
                    (8, "in_progress", None)]
    assert res.timeline.filter(F.col("origin") == "handler").count() == 6


def test_escalation_selection_and_idempotence(spark):
    past = AS_OF - timedelta(days=1)
    m = make_model(spark, complaints=[
        complaint(id=1, sla_deadline=past, is_overdue=False),
        complaint(id=2, sla_deadline=past, is_overdue=None),                     # NULL flag: excluded
        complaint(id=3, sla_deadline=past, is_overdue=True),
        complaint(id=4, sla_deadline=past, is_overdue=False, status="closed"),   # closed is escalated (D2)
        complaint(id=5, sla_deadline=past, is_overdue=False, status="rejected"),
        complaint(id=6, sla_deadline=AS_OF, is_overdue=False),                   # not strictly before
    ])
    first = lifecycle.escalate_overdue(m)
    assert sorted(r["id"] for r in first.changed.collect()) == [1, 4]
    again = lifecycle.escalate_overdue(m.replace(complaints=first.snapshot))
    assert again.changed.count() == 0


def test_votes_threshold_and_repeats(spark):
    m = make_model(spark, complaints=[
        complaint(id=1, complaint_no="N1", upvote_count=8),
        complaint(id=2, complaint_no="N2", upvote_count=None),
        complaint(id=3, complaint_no="N3", upvote_count=12),
        complaint(id=4, complaint_no="N4", upvote_count=9, priority="urgent")],
        upvotes=[dict(id=100, complaint_id=1, voter_ip="a", voted_at=D(2024, 1, 1))])
    t = D(2024, 3, 1)
    req = spark.createDataFrame([
        (1, "N1", "a", t),                         # stored already
        (2, "N1", "b", t + timedelta(seconds=1)),  # 9
        (3, "N1", "c", t + timedelta(seconds=2)),  # 10: crossing
        (4, "N1", "d", t + timedelta(seconds=3)),  # 11
        (5, "N1", "b", t + timedelta(seconds=4)),  # repeat inside the batch
        (6, "N2", "a", t),
        (7, "N3", "z", t),                         # base 12, normal: first vote crosses with 13
        (8, "N4", "z", t),                         # not normal: never
        (9, "XX", "z", t),
    ], "vote_id long, complaint_no string, voter_ip string, ts timestamp_ntz")
    res = votes.apply_upvotes(m, req)
    assert dict(rows(res.rejects, "vote_id", "reason")) == {1: "Already upvoted", 5: "Already upvoted",
                                                            9: "Complaint not found"}
    assert dict(rows(res.counts, "complaint_id", "upvote_count")) == {1: 11, 2: 1, 3: 13, 4: 10}
    cross = rows(votes.community_escalation(m, res), "complaint_id", "vote_id", "upvote_count")
    assert cross == [(1, 3, 10), (3, 7, 13)]


def test_sequence_widens_past_five_digits(spark):
    acc = spark.createDataFrame([(1, D(2024, 1, 1), "D01"), (2, D(2024, 1, 2), "D02")],
                                "request_id long, ts timestamp_ntz, district_code string")
    got = rows(intake.assign_complaint_no(acc, start=99999), "request_id", "complaint_no")
    assert got == [(1, "AP-2024-D01-99999"), (2, "AP-2024-D02-100000")]


def test_code_expiry_boundaries(spark):
    t = D(2024, 1, 1)
    ttl = timedelta(seconds=600)
    ev = spark.createDataFrame([
        (1, "9000000001", "send", "111111", t),
        (2, "9000000001", "attempt", "111111", t + ttl),                           # exactly at expiry: ok
        (3, "9000000001", "attempt", "111111", t + ttl + timedelta(seconds=1)),    # code gone
        (4, "9000000002", "send", "222222", t),
        (5, "9000000002", "attempt", "000000", t + timedelta(seconds=1)),          # wrong: kept
        (6, "9000000002", "attempt", "222222", t + ttl + timedelta(microseconds=1)),  # expired
        (7, "900000003", "send", "333333", t),                                     # 9 digits
        (8, "900000003", "attempt", "333333", t),
        (9, "9000000004", "attempt", "444444", t),                                 # nothing sent
    ], "event_id long, phone string, kind string, code string, ts timestamp_ntz")
    got = dict(rows(timing.code_verification(ev, 600), "event_id", "verdict"))
    assert got == {1: "sent", 2: "verified", 3: "not_requested", 4: "sent", 5: "incorrect", 6: "expired",
                   7: "invalid_phone", 8: "not_requested", 9: "not_requested"}


def test_upload_limits(spark):
    mib = 10 * 1024 * 1024
    up = spark.createDataFrame(
        [(i, 1, "image/png", 100) for i in range(6)] +                       # 6 files
        [(10, 2, "application/pdf", mib), (11, 3, "image/jpeg", mib + 1)],
        "file_id long, request_id long, mimetype string, size_bytes long")
    got = dict(rows(intake.upload_verdicts(up), "request_id", "upload_reason"))
    assert got == {1: "Too many files", 2: None, 3: "File too large"}
    kinds = dict(rows(intake.attachment_classify(up), "file_id", "file_type"))
    assert kinds[10] == "pdf" and kinds[11] == "image"


def test_registration_duplicates(spark):
    m = make_model(spark, citizens=[dict(id=1, name="x", phone="9000000001")])
    req = spark.createDataFrame([
        (1, "a", "9000000001", None, None, None, None, None, D(2024, 1, 1)),   # existing phone
        (2, "b", "9000000002", None, None, None, None, "en", D(2024, 1, 2)),
        (3, "c", "9000000002", None, None, None, None, None, D(2024, 1, 1)),   # earlier: wins
        (4, "", "9000000003", None, None, None, None, None, D(2024, 1, 1)),
    ], "request_id long, name string, phone string, email string, district_id int, mandal_id int, "
       "village string, lang_pref string, ts timestamp_ntz")
    got = {r["request_id"]: (r["accepted"], r["lang_pref"]) for r in intake.register_citizens(m, req).collect()}
    assert got == {1: (False, "te"), 2: (False, "en"), 3: (True, "te"), 4: (False, "te")}


def test_registration_refused_by_the_table(spark):
    m = make_model(spark, citizens=[dict(id=1, name="x", phone="9000000001")],
                   mandals=[dict(id=4, district_id=1, name="m")])
    t, long = D(2024, 1, 1), "x" * 201
    req = spark.createDataFrame([
        (1, long, "1", None, 1, None, None, None, t), (2, "a", "1" * 16, None, 1, None, None, None, t),
        (3, "a", "3", long, 1, None, None, None, t), (4, "a", "4", None, 77, None, None, None, t),
        (5, "a", "5", None, 1, 5, None, None, t), (6, "a", "6", None, 1, 4, long, None, t),
        (7, "a", "7", None, 1, 4, None, "telugu", t), (8, long, "9000000001", None, 1, None, None, None, t),
        (9, "a", "9", None, 77, None, None, None, t),                               # refused: does not take its phone
        (10, "b", "9", "e", 1, 4, "v", None, t + timedelta(hours=1)),
        (11, long, "9", None, 1, None, None, None, t + timedelta(hours=2)),         # the phone is taken by then
        (12, "a", "12", None, None, None, None, "", t),
    ], "request_id long, name string, phone string, email string, district_id int, mandal_id int, "
       "village string, lang_pref string, ts timestamp_ntz")
    got = {r["request_id"]: r for r in intake.register_citizens(m, req).collect()}
    taken = "Phone already registered. Please login."
    assert {k: r["reason"] for k, r in got.items()} == {
        1: "Name too long", 2: "Phone too long", 3: "Email too long", 4: "Invalid district", 5: "Invalid mandal",
        6: "Village too long", 7: "Language too long", 8: taken, 9: "Invalid district", 10: None, 11: taken, 12: None}
    assert (got[10]["email"], got[10]["mandal_id"], got[10]["village"]) == ("e", 4, "v")
    assert got[12]["accepted"] and got[12]["lang_pref"] == "te"


def test_escalation_passes_write_changes_only(spark):
    from civiccases.streaming import streams
    old, soon = AS_OF - timedelta(days=1), AS_OF + timedelta(hours=1)
    m = make_model(spark, complaints=[complaint(id=1, sla_deadline=old), complaint(id=2, sla_deadline=soon),
                                      complaint(id=3, sla_deadline=soon, status="resolved"), complaint(id=4)])
    root = streams.run_dir(spark, "test-escalation")
    assert streams.escalated_rows(spark, root) is None
    runs = [AS_OF, AS_OF + timedelta(days=1)]
    assert rows(streams.escalation_schedule(spark, m, runs, root), "id", "updated_at") == [(1, runs[0]), (2, runs[1])]
    # a repeated pass gives the same rows again
    assert rows(streams.escalation_run(spark, m, runs[1], root), "id") == [(2,)]
    after = streams.escalated_snapshot(spark, m, root)
    assert after.columns == m.complaints.columns
    assert rows(after, "id", "is_overdue", "priority") == [(1, True, "emergency"), (2, True, "emergency"),
                                                           (3, False, "normal"), (4, False, "normal")]


def test_sla_days_zero_and_null_default_to_seven(spark):
    deps = [dict(id=1, name="a", code="A", sla_days=0, is_active=True),
            dict(id=2, name="b", code="B", sla_days=None, is_active=True),
            dict(id=3, name="c", code="C", sla_days=3, is_active=True)]
    m = make_model(spark, departments=deps)
    req = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 1, 42)],
                                "request_id long, department_id int, district_id int")
    got = {r["request_id"]: (r["sla_days"], r["ref_reason"]) for r in intake.resolve_reference(m, req).collect()}
    assert got == {1: (7, None), 2: (7, None), 3: (3, None), 4: (7, "Invalid department"),
                   5: (7, "Invalid district")}


def test_audit_finds_planted_violations(spark):
    m = make_model(spark, complaints=[complaint(id=1, is_anonymous=True, district_id=77),
                                      complaint(id=2, complaint_no="DUP"), complaint(id=3, complaint_no="DUP",
                                                                                     status="bogus")],
                   notifications=[dict(id=1, complaint_id=1, citizen_id=5, channel="sms", message="m")])
    got = {(r["table_name"], r["rule"], r["column_name"]): r["n_violations"]
           for r in quality.constraint_audit(m, only_violations=True).collect()}
    assert got[("notifications", "anonymity_leak", "citizen_id")] == 1
    assert got[("complaints", "foreign_key:districts", "district_id")] == 1
    assert got[("complaints", "unique", "complaint_no")] == 1
    assert got[("complaints", "domain", "status")] == 1
    assert got[("notifications", "foreign_key:citizens", "citizen_id")] == 1


def test_audit_finds_one_planted_violation_of_every_rule(spark):
    """Two rows a table that break each of its rules once (a NULL, a long text, an unknown key or word, a repeat)."""
    from civiccases.oracle.queries_sql import audit_rules
    from civiccases.sources.model import SCHEMAS
    m = make_model(spark)
    planted = {}
    for name, schema in SCHEMAS.items():
        open_schema = type(schema)([type(f)(f.name, f.dataType, True) for f in schema.fields])
        marks = [(rule, column, arg) for table, rule, column, arg in audit_rules() if table == name]
        rows = []
        for rule, column, arg in marks:     # a pair of rows a rule, so that rules do not mask each other
            row = {f.name: None for f in schema.fields}
            if rule.startswith("max_length"):
                row[column] = "x" * (int(arg) + 1)
            elif rule == "domain":
                row[column] = "bogus"
            elif rule == "anonymity_leak":
                row |= {"complaint_id": 4242, column: 4}
            elif rule.startswith("foreign_key"):
                row[column] = 999
            rows.append(row)
            if rule == "unique":
                for c in column.split(","):
                    row[c] = 77 if schema[c].dataType.typeName() != "string" else "twice"
                rows.append(dict(row))
        if name == "complaints":
            rows.append({f.name: None for f in schema.fields} | {"id": 4242, "is_anonymous": True})
        planted[name] = spark.createDataFrame([tuple(r.values()) for r in rows], open_schema)
    got = {(r["table_name"], r["rule"], r["column_name"]): r["n_violations"]
           for r in quality.constraint_audit(m.replace(**planted)).collect()}
    assert set(got) == {(t, r, c) for t, r, c, _ in audit_rules()}
    assert [k for k, n in got.items() if n < 1] == []
    assert got[("notifications", "anonymity_leak", "citizen_id")] == 1
    assert got[("complaints", "unique", "complaint_no")] == 1
    assert got[("complaints", "foreign_key:officers", "assigned_to")] == 1
    clean = quality.constraint_audit(make_model(spark), only_violations=True)
    assert clean.count() == 0


def test_audit_reads_each_table_twice(spark, tmp_path):
    from civiccases.sources.model import load_model
    from civiccases.sources.sinks import write_snapshot
    m = load_model(spark, write_snapshot(make_model(spark, complaints=[complaint(id=1)]), str(tmp_path / "s")), AS_OF)
    plan = quality.constraint_audit(m)._jdf.queryExecution().optimizedPlan().toString()
    leaves = [x for x in plan.splitlines() if "Relation [" in x and "complaint_no" in x and "department_id" in x]
    assert len(leaves) == 2, plan


def test_purge_cascades_and_refuses(spark):
    m = make_model(spark, complaints=[complaint(id=1), complaint(id=2)],
                   attachments=[dict(id=1, complaint_id=1, file_url="u"), dict(id=2, complaint_id=1, file_url="v")],
                   timeline=[dict(id=1, complaint_id=1, status="submitted")],
                   notifications=[dict(id=1, complaint_id=2, channel="sms", message="m")])
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r["complaint_id"]: (r["outcome"], r["attachments_removed"], r["timeline_removed"])
           for r in quality.cascade_purge(m, ids).collect()}
    assert got == {1: ("purged", 2, 1), 2: ("refused_notifications", 0, 0), 3: ("not_found", 0, 0)}
    after = quality.apply_purge(m, ids)
    assert after.complaints.count() == 1 and after.attachments.count() == 0


def test_rate_limit_blocks_after_max(spark):
    t = D(2024, 1, 1, 10)
    req = spark.createDataFrame([(i, "c1", "file_complaint", t + timedelta(minutes=i)) for i in range(1, 7)] +
                                [(7, "c1", "file_complaint", t + timedelta(days=1))],
                                "request_id long, client string, route string, ts timestamp_ntz")
    limits = [("complaint", 86400, 5, "file_complaint"), ("upvote", 3600, 1, "")]
    got = dict(rows(timing.rate_limit_verdicts(req, limits), "request_id", "allowed"))
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True}
    v = timing.rate_limit_violators(req, limits).collect()
    assert [(r["n_requests"], r["n_blocked"]) for r in v] == [(6, 1)]


def test_anonymous_filing_and_messages(spark):
    m = make_model(spark, citizens=[dict(id=5, name="Asha", phone="9000000005", lang_pref="te")])
    req = spark.createDataFrame([
        (1, 5, 1, 1, None, None, "t", "d", None, None, None, "", "true", "123412341234", None, D(2024, 1, 1)),
        (2, 5, 1, 1, None, None, "", "d", None, None, None, None, "false", None, None, D(2024, 1, 1)),
    ], "request_id long, caller_id long, department_id int, district_id int, mandal_id int, village string, "
       "title string, description string, priority string, latitude string, longitude string, address string, "
       "is_anonymous string, aadhaar string, source string, ts timestamp_ntz")
    res = intake.file_complaints(m, req)
    c = res.complaints.first()
    assert c["citizen_id"] is None and c["is_anonymous"] and c["priority"] == "normal" and c["source"] == "web"
    assert c["address"] is None and c["is_public"]
    assert c["sla_deadline"] == D(2024, 1, 8)
    assert rows(res.rejects, "request_id", "reason") == [(2, intake.REQUIRED_FIELDS_REASON)]
    # the filing SMS still goes to the caller, and the outbox row carries the caller (the leak)
    msgs = lifecycle.compose_messages(m, res.events).collect()
    assert len(msgs) == 1 and "AP-2024-D01-00001" in msgs[0]["message"]
    assert res.outbox.first()["citizen_id"] == 5
    assert res.citizen_updates.first()["aadhaar_hash"] is not None


def test_identity_hash_updates_citizen(spark):
    import hashlib
    m = make_model(spark, citizens=[dict(id=5, name="a", phone="9000000005"), dict(id=6, name="b", phone="9000000006")])
    req = spark.createDataFrame([(1, 5, "111122223333", D(2024, 1, 1)), (2, 5, "444455556666", D(2024, 1, 2)),
                                 (3, 6, "", D(2024, 1, 1))],
                                "request_id long, caller_id long, aadhaar string, ts timestamp_ntz")
    upd = intake.hash_identity(req)
    got = {r["id"]: r["aadhaar_hash"] for r in intake.apply_identity(m, upd).collect()}
    assert got == {5: hashlib.sha256(b"444455556666").hexdigest(), 6: None}


def test_case_file_nested_and_empty(spark):
    t = D(2024, 1, 1)
    m = make_model(spark, complaints=[complaint(id=1), complaint(id=2)],
                   officers=[dict(id=7, name="Officer Seven", email="o7@x")],
                   attachments=[dict(id=11, complaint_id=1, file_url="b", file_type="pdf", uploaded_at=t + timedelta(hours=2)),
                                dict(id=10, complaint_id=1, file_url="a", file_type="image", uploaded_at=t)],
                   timeline=[dict(id=2, complaint_id=1, status="resolved", updated_by=7, created_at=t + timedelta(days=1)),
                             dict(id=1, complaint_id=1, status="submitted", created_at=t)])
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r["complaint"]["id"]: r for r in lookups.case_file(m, ids).collect()}
    assert [a["file_url"] for a in got[1]["attachments"]] == ["a", "b"]
    assert [(e["status"], e["updated_by"]) for e in got[1]["timeline"]] == [("submitted", None),
                                                                           ("resolved", "Officer Seven")]
    assert got[2]["attachments"] == [] and got[2]["timeline"] == []


def test_snapshot_rewrite_leaves_no_stale_year(spark, tmp_path):
    from civiccases.sources.sinks import write_snapshot
    for year, n in ((1997, 3), (1998, 2)):
        m = make_model(spark, complaints=[complaint(id=i + 1, created_at=datetime(year, 5, i + 1)) for i in range(n)])
        write_snapshot(m, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/complaints").select("created_year").collect()
    assert [r[0] for r in rows] == [1998, 1998]


def test_report_rows_come_by_total(spark):
    m = make_model(spark, complaints=[complaint(id=i, district_id=2 if i < 4 else 1, department_id=3 if i < 4 else 1)
                                      for i in range(1, 6)])
    for report, key in ((reports.district_summary, "district_id"), (reports.cm_by_district, "district_id"),
                        (reports.dept_summary, "department_id"), (reports.cm_by_department, "department_id")):
        rows = [(-r["total"], r[key]) for r in report(m).collect()]
        assert rows == sorted(rows) and rows[0][0] == -3


def test_malformed_coordinates_do_not_end_the_batch(spark):
    rows = spark.createDataFrame([(1, "abc", "1.5", "x", "web", "normal"), (1, "17.25", "", "x", "web", "normal")],
                                 "department_id int, latitude string, longitude string, address string, "
                                 "source string, priority string")
    got = intake.defaults_and_visibility(rows).collect()
    assert [(r["latitude"], r["longitude"]) for r in got][0][0] is None and float(got[1]["latitude"]) == 17.25


def test_escalation_filter_reaches_the_scan(spark, tmp_path):
    import dataclasses

    from civiccases.sources.sinks import write_snapshot
    m = make_model(spark, complaints=[complaint(id=1)])
    stored = spark.read.parquet(write_snapshot(m, str(tmp_path)) + "/complaints").drop("created_year")
    plan = lifecycle.escalation_candidates(dataclasses.replace(m, complaints=stored))
    text = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "sla_deadline" in pushed and "is_overdue" in pushed


def test_login_of_an_inactive_officer_is_not_seen(spark):
    officers = [dict(id=1, name="a", email="a", phone="1", department_id=1, district_id=1, role="officer", is_active=a)
                for a in (True, False)]
    officers[1]["id"] = 2
    logins = spark.createDataFrame([("officer", 1, datetime(2024, 1, 1)), ("officer", 2, datetime(2024, 1, 1))],
                                   "actor_type string, actor_id long, ts timestamp_ntz")
    got = {r["id"]: r["last_login"] for r in lifecycle.last_seen(make_model(spark, officers=officers), logins).collect()}
    assert got == {1: datetime(2024, 1, 1), 2: None}


REQUEST_SCHEMA = ("request_id long, caller_id long, department_id int, district_id int, mandal_id int, village string, "
                  "title string, description string, priority string, latitude string, longitude string, "
                  "address string, is_anonymous string, aadhaar string, source string, ts timestamp_ntz")


def test_table_constraints_reject_a_filing(spark):
    m = make_model(spark, citizens=[dict(id=5, name="Asha", phone="9000000005")],
                   mandals=[dict(id=4, district_id=1, name="M")])
    fine = dict(caller_id=5, department_id=1, district_id=1, mandal_id=4, village=None, title="t", description="d",
                priority="", latitude="17.25", longitude="", address=None, is_anonymous="false", aadhaar=None,
                source=None, ts=D(2024, 1, 1))
    cases = [({}, None), ({"priority": "purple"}, intake.INVALID_PRIORITY), ({"priority": "urgent"}, None),
             ({"latitude": "abc"}, intake.INVALID_COORDINATES), ({"longitude": "99999"}, intake.INVALID_COORDINATES),
             ({"title": "x" * 301}, intake.TITLE_TOO_LONG), ({"title": "x" * 300}, None),
             ({"village": "v" * 201}, intake.VILLAGE_TOO_LONG), ({"source": "s" * 21}, intake.SOURCE_TOO_LONG),
             ({"mandal_id": 99}, intake.INVALID_MANDAL), ({"mandal_id": None}, None),
             ({"caller_id": 6}, intake.UNKNOWN_CALLER), ({"caller_id": None}, None),
             ({"caller_id": 6, "is_anonymous": "true"}, None)]
    names = [part.split()[0] for part in REQUEST_SCHEMA.split(", ")]
    req = spark.createDataFrame([tuple(({"request_id": i} | fine | change)[n] for n in names)
                                 for i, (change, _) in enumerate(cases)], REQUEST_SCHEMA)
    res = intake.file_complaints(m, req)
    assert dict(rows(res.rejects, "request_id", "reason")) == {i: why for i, (_, why) in enumerate(cases) if why}
    assert [r[0] for r in rows(res.complaints, "id")] == [i for i, (_, why) in enumerate(cases) if not why]
    # the anonymous filing of an unknown caller is stored, but nobody can be notified
    assert len(cases) - 1 not in [r[0] for r in rows(res.outbox, "complaint_id")]


def test_every_page_equals_the_plain_sort(spark):
    made = [complaint(id=i, upvote_count=None if i % 7 == 0 else i % 3, created_at=D(2024, 1, 1) + timedelta(hours=i % 50))
            for i in range(1, 76)]
    m = make_model(spark, complaints=made)
    votes_first = sorted(made, key=lambda c: (c["upvote_count"] is not None, -(c["upvote_count"] or 0),
                                              -c["created_at"].timestamp(), c["id"]))
    want = [c["complaint_no"] for c in votes_first]
    got = [[r["complaint_no"] for r in lookups.public_feed(m, page_no=k).collect()] for k in range(1, 6)]
    assert got == [want[i:i + 20] for i in range(0, 100, 20)]


def test_contacts_by_phone_and_by_id(spark):
    m = make_model(spark, citizens=[dict(id=5, name="a", phone="1"), dict(id=6, name="b", phone="2")])
    phones = spark.createDataFrame([("2",), ("2",), ("9",), (None,)], "phone string")
    ids = spark.createDataFrame([(5,), (5,), (9,), (None,)], "id long")
    assert rows(lookups.contact_by_phone(m, phones), "id") == [(6,)]
    assert rows(lookups.contact_by_id(m, ids), "id") == [(5,)]
