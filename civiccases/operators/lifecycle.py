"""J-12..J-15, J-18, J-19: status changes, escalation, messages, last seen.

Each job maps (previous snapshot, requests, as_of) to new DataFrames: the
changed rows, the rows appended to the timeline/outbox, and rejects.  The
next snapshot is ``unchanged UNION changed``; only changed rows are joined
against the snapshot (SURVEY 4.2 item 5).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiccases.functions.expr import overdue_at, ts_lit
from civiccases.operators.intake import first_reason
from civiccases.plans.sequences import bucketed_lag
from civiccases.sources.model import (ESCALATION_EXCLUDED, ESCALATION_NOTE, MESSAGE_TEMPLATES, SETTABLE_STATUSES, Model,
                                      message_templates)

INVALID_STATUS = "Invalid status"
NOT_FOUND = "Complaint not found"
UNKNOWN_OFFICER = "Unknown officer"


# ------------------------------------------------------------------ J-12

def overdue_flag(m: Model) -> DataFrame:
    """The live flag per complaint at ``as_of`` (three-valued)."""
    return m.complaints.select("id", "status", "sla_deadline", overdue_at(m.as_of).alias("is_overdue"))


# ------------------------------------------------------------------ J-13

@dataclass
class StatusResult:
    changed: DataFrame     # id, status, updated_at, resolved_at (new values)
    snapshot: DataFrame    # the next complaints snapshot
    timeline: DataFrame    # handler rows + trigger rows (J-14), with an 'origin' column
    rejects: DataFrame     # update_id, reason


def _checked_updates(m: Model, updates: DataFrame) -> DataFrame:
    """Adds ``reason`` (the status, then the complaint, then the officer that the timeline row refers to) and the
    complaint's stored status, officer and time of resolution: the one join with the complaints that all outputs read.

    Unknown officers are found among the distinct officers of the updates, so a
    busy officer is one row before any join.  They are joined first: what the
    complaints add is moved by no further join.
    """
    known = m.complaints.select(F.col("id").alias("_known"), F.col("status").alias("_base_status"),
                                F.col("assigned_to").alias("_assigned"), F.col("resolved_at").alias("_base_resolved"))
    strangers = (updates.select(F.col("officer_id").alias("_stranger")).where("_stranger is not null").distinct()
                 .join(m.officers.select(F.col("id").alias("_oid")), F.col("_stranger") == F.col("_oid"), "left_anti"))
    u = (updates.join(strangers, F.col("officer_id") == F.col("_stranger"), "left")
         .join(known, F.col("complaint_id") == F.col("_known"), "left"))
    return u.withColumn("reason", first_reason((~F.col("status").isin(*SETTABLE_STATUSES) |
                                                F.col("status").isNull(), INVALID_STATUS),
                                               (F.col("_known").isNull(), NOT_FOUND),
                                               (F.col("_stranger").isNotNull(), UNKNOWN_OFFICER))
                        ).drop("_known", "_stranger")


def status_changes(updates_ok: DataFrame) -> DataFrame:
    """Final values per complaint after applying its updates in (ts, update_id) order.

    max_by / max merge partially, so a complaint with very many updates is
    reduced in every map task before the shuffle.
    """
    order = F.struct("ts", "update_id")
    return updates_ok.groupBy("complaint_id").agg(
        F.max_by("status", order).alias("new_status"),
        F.max("ts").alias("new_updated_at"),
        F.coalesce(F.max(F.when(F.col("status") == "resolved", F.col("ts"))), F.max("_base_resolved")).alias("new_resolved_at"))


def apply_status_updates(m: Model, updates: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None,
                         keep_log: Callable[[DataFrame], DataFrame] | None = None) -> StatusResult:
    """All outputs read the checked updates, the log several times: ``keep`` may store them, computed once, or
    ``keep_log`` what the log reads of them, where nothing else is wanted."""
    checked = _checked_updates(m, updates)
    if keep is not None:
        checked = keep(checked)
    ok = checked.filter(F.col("reason").isNull()).drop("reason")
    rejects = checked.filter(F.col("reason").isNotNull()).select("update_id", "reason")
    changed = status_changes(ok).select(F.col("complaint_id").alias("id"), F.col("new_status").alias("status"),
                                        F.col("new_updated_at").alias("updated_at"),
                                        F.col("new_resolved_at").alias("resolved_at"))
    upd = changed.select(F.col("id").alias("_cid"), F.col("status").alias("_s"),
                         F.col("updated_at").alias("_u"), F.col("resolved_at").alias("_r"))
    snapshot = (m.complaints.join(upd, F.col("id") == F.col("_cid"), "left")
                    .withColumn("status", F.coalesce("_s", "status"))
                    .withColumn("updated_at", F.when(F.col("_cid").isNotNull(), F.col("_u"))
                                .otherwise(F.col("updated_at")))
                    .withColumn("resolved_at", F.when(F.col("_cid").isNotNull(), F.col("_r"))
                                .otherwise(F.col("resolved_at")))
                    .drop("_cid", "_s", "_u", "_r"))
    handler = ok.select("complaint_id", "status", "note", F.col("officer_id").alias("updated_by"),
                        F.col("ts").alias("created_at"), "update_id", F.lit("handler").alias("origin"))
    trigger = status_change_log(ok, keep_log)
    return StatusResult(changed=changed, snapshot=snapshot, timeline=handler.unionByName(trigger), rejects=rejects)


# ------------------------------------------------------------------ J-14

def status_change_log(u: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Trigger rows of checked updates: one whose status IS DISTINCT FROM the one before it.

    The status before the first update of a batch is the snapshot's; the
    trigger logs the complaint's ``assigned_to`` (unchanged by status updates).
    """
    if keep is not None:
        u = keep(u.select("update_id", "complaint_id", "status", "ts", "_base_status", "_assigned"))
    # lag per complaint, one with a huge history split by day so that it is not one task
    u = bucketed_lag(u, "complaint_id", F.date_trunc("day", "ts"), ["ts", "update_id"], "status", "_prev",
                     F.col("_base_status"))
    return (u.filter(~F.col("status").eqNullSafe(F.col("_prev")))
             .select("complaint_id", "status", F.lit(None).cast("string").alias("note"),
                     F.col("_assigned").alias("updated_by"), F.col("ts").alias("created_at"), "update_id",
                     F.lit("trigger").alias("origin")))


# ------------------------------------------------------------------ J-15

@dataclass
class EscalationResult:
    changed: DataFrame
    snapshot: DataFrame
    timeline: DataFrame
    messages: DataFrame


def escalation_predicate(m: Model, excluded: list[str] | None = None):
    """deadline < as_of AND status NOT IN (excluded) AND stored flag = FALSE (NULL where a part is unknown).

    Plain comparisons, so a filter with it reaches the parquet scan.
    """
    return (F.col("sla_deadline") < ts_lit(m.as_of)) & escalation_open(excluded)


def escalation_open(excluded: list[str] | None = None):
    """The part of the predicate that no clock changes: status NOT IN (excluded) AND stored flag = FALSE."""
    return ~F.col("status").isin(*(excluded or ESCALATION_EXCLUDED)) & (F.col("is_overdue") == F.lit(False))


def escalation_candidates(m: Model, excluded: list[str] | None = None) -> DataFrame:
    return m.complaints.filter(escalation_predicate(m, excluded))


def escalate_overdue(m: Model, excluded: list[str] | None = None) -> EscalationResult:
    """Flag, raise to emergency, log and message every newly overdue complaint.

    The selection is row-local, so the next snapshot is one projection of the
    previous one (no join, no shuffle).  Idempotent: the flag it sets
    excludes the row from the next run.
    """
    hit = F.coalesce(escalation_predicate(m, excluded), F.lit(False))
    cand = escalation_candidates(m, excluded)
    as_of = ts_lit(m.as_of)
    changed = cand.select("id", "complaint_no", F.lit(True).alias("is_overdue"),
                          F.lit("emergency").alias("priority"), as_of.alias("updated_at"))
    snapshot = (m.complaints.withColumn("_hit", hit)
                .withColumn("is_overdue", F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("is_overdue")))
                .withColumn("priority", F.when(F.col("_hit"), F.lit("emergency")).otherwise(F.col("priority")))
                .withColumn("updated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at")))
                .drop("_hit"))
    timeline = changed.select(F.col("id").alias("complaint_id"), F.lit("in_progress").alias("status"),
                              F.lit(ESCALATION_NOTE).alias("note"), F.lit(None).cast("int").alias("updated_by"),
                              as_of.alias("created_at"))
    events = cand.select(F.lit("escalated").alias("event"), F.col("id").alias("complaint_id"), "complaint_no",
                         "citizen_id")
    return EscalationResult(changed=changed, snapshot=snapshot, timeline=timeline,
                            messages=compose_messages(m, events))


# ------------------------------------------------------------------ J-18

def compose_messages(m: Model, events: DataFrame) -> DataFrame:
    """events(event, complaint_id, complaint_no, citizen_id) -> (event, complaint_id, phone, message).

    Inner join to citizens: rows without a (known) citizen get no message.
    Events without a template (assigned, rejected) get none either.
    """
    cit = m.citizens.select(F.col("id").alias("_cit"), "phone", F.col("name").alias("_name"),
                            F.col("lang_pref").alias("_lang"))
    e = events.join(cit, F.col("citizen_id") == F.col("_cit"), "inner")
    # filing texts are chosen by language ('te', anything else -> 'en'); the rest by event only
    lang_key = F.when(F.col("event") == "filed",
                      F.when(F.col("_lang") == "te", F.lit("te")).otherwise(F.lit("en"))).otherwise(F.lit("*"))
    t = F.broadcast(message_templates(m.complaints.sparkSession)
                    .select(F.col("event").alias("_tev"), F.col("lang").alias("_tlang"), "template"))
    e = e.withColumn("_lkey", lang_key).join(
        t, (F.col("event") == F.col("_tev")) & (F.col("_lkey") == F.col("_tlang")), "inner")
    message = (F.when(F.col("event") == "filed", F.expr("format_string(template, _name, complaint_no)"))
                .otherwise(F.expr("format_string(template, complaint_no)")))
    return e.select("event", "complaint_id", "phone", message.alias("message"))


def welcome_messages(registrations: DataFrame) -> DataFrame:
    """The message to the phone of every accepted registration (rows of ``intake.register_citizens``)."""
    text = next(template for event, _, template in MESSAGE_TEMPLATES if event == "registered")
    return registrations.where("accepted").select(
        F.lit("registered").alias("event"), F.lit(None).cast("long").alias("complaint_id"), "phone", F.lit(text).alias("message"))


def notification_events(m: Model, filings=None, status: StatusResult | None = None,
                        escalation: bool = False) -> DataFrame:
    """All message events of a run: filings (to the caller), handler status rows, escalations."""
    parts = []
    if filings is not None:
        parts.append(filings.events)
    if status is not None:
        nums = m.complaints.select(F.col("id").alias("_cid"), "complaint_no", "citizen_id")
        parts.append(status.timeline.filter(F.col("origin") == "handler")
                     .join(nums, F.col("complaint_id") == F.col("_cid"))
                     .select(F.col("status").alias("event"), "complaint_id", "complaint_no", "citizen_id"))
    if escalation:
        parts.append(escalation_candidates(m).select(F.lit("escalated").alias("event"),
                                                     F.col("id").alias("complaint_id"), "complaint_no",
                                                     "citizen_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ J-19

def last_seen(m: Model, logins: DataFrame) -> DataFrame:
    """last_login per citizen and officer: greatest(stored, latest login in the log).

    Inactive officers are refused at login, so theirs stays.
    """
    latest = logins.groupBy("actor_type", "actor_id").agg(F.max("ts").alias("_seen"))

    def side(df: DataFrame, kind: str) -> DataFrame:
        l = latest.filter(F.col("actor_type") == kind)
        admitted = F.col("is_active") if kind == "officer" else F.lit(True)
        j = df.select(F.col("id").cast("long").alias("id"), "last_login", admitted.alias("_admitted")).join(
            l, (F.col("id") == F.col("actor_id")) & F.col("_admitted"), "left")
        return j.select(F.lit(kind).alias("actor_type"), "id",
                        F.greatest("last_login", "_seen").alias("last_login"))

    return side(m.citizens, "citizen").unionByName(side(m.officers, "officer"))
