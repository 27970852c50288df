"""Batch twins of the time rules: R-04 rate limits, R-05 one-time codes, R-07 rolling windows.

The streams in ``civiccases.streaming`` compute the same results
incrementally; these batch forms are what the DuckDB oracle checks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.functions.expr import plus_seconds, ts_lit, with_caller
from civiccases.plans.keys import same, whole_keys
from civiccases.plans.slices import SLICE_ROWS, with_slice
from civiccases.sources.model import CODE_TTL_SECONDS, PHONE_LENGTH, RATE_LIMITS, Model

EPOCH = "1970-01-01 00:00:00"

# Limits used on the fixture (the real ones almost never fire on it).
TEST_RATE_LIMITS = [
    ("general", 86400, 4, "*"),
    ("otp", 86400, 2, "otp_send,otp_verify"),
    ("complaint", 86400, 1, "file_complaint"),
    ("upvote", 86400, 20, ""),
]


def window_start(ts: Column | str, seconds: int) -> Column:
    """Fixed windows aligned to the epoch (our choice; the reference leaves it to a library)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    secs = F.timestamp_diff("SECOND", ts_lit(EPOCH), c)
    return plus_seconds(ts_lit(EPOCH), F.floor(secs / F.lit(seconds)) * F.lit(seconds))


def _guarded(requests: DataFrame, routes: str) -> DataFrame | None:
    if routes == "":
        return None                      # declared but guarding no route (D18)
    if routes == "*":
        return requests
    return requests.filter(F.col("route").isin(*routes.split(",")))


def rate_limit_verdicts(requests: DataFrame, limits=None) -> DataFrame:
    """Per (request, limiter guarding its route): allowed iff among the first ``max`` of its window.

    The first refused request of each (client, window) over its limit comes from
    a ``row_number() = max + 1`` with a literal bound, which Spark plans as a
    WindowGroupLimit below the shuffle: a client that sends a third of all
    requests ships only ``max + 1`` rows per map task, never its whole history.
    Every request then compares itself with the refusal of its own group; only
    groups over their limit have one, so that table is small where limits hold.
    """
    parts = []
    requests = with_caller(requests, "client")
    for limiter, seconds, max_req, routes in (limits or RATE_LIMITS):
        r = _guarded(requests, routes)
        if r is None:
            continue
        r = r.select("request_id", "client", "route", "ts", window_start("ts", seconds).alias("window_start"))
        w = Window.partitionBy("client", "window_start").orderBy("ts", "request_id")
        refused = (r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == F.lit(max_req + 1))
                    .select(F.col("client").alias("_c"), F.col("window_start").alias("_w"),
                            F.struct("ts", "request_id").alias("_from")))
        v = r.join(refused, F.col("client").eqNullSafe(F.col("_c")) & F.col("window_start").eqNullSafe(F.col("_w")), "left")
        allowed = F.col("_from").isNull() | (F.struct("ts", "request_id") < F.col("_from"))
        parts.append(v.select("request_id", "client", "route", F.lit(limiter).alias("limiter"), "window_start",
                              allowed.alias("allowed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rate_limit_violators(requests: DataFrame, limits=None) -> DataFrame:
    """(client, limiter, window) groups over their limit: a partial count, skew-safe."""
    parts = []
    requests = with_caller(requests, "client")
    for limiter, seconds, max_req, routes in (limits or RATE_LIMITS):
        r = _guarded(requests, routes)
        if r is None:
            continue
        g = (r.groupBy("client", window_start("ts", seconds).alias("window_start"))
              .agg(F.count(F.lit(1)).alias("n_requests"))
              .filter(F.col("n_requests") > max_req))
        parts.append(g.select("client", F.lit(limiter).alias("limiter"), "window_start", "n_requests",
                              (F.col("n_requests") - F.lit(max_req)).alias("n_blocked")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_state(events: DataFrame, keys: list[str], carried: Column) -> DataFrame:
    """Adds ``_epoch`` (valid sends so far in the slice), ``_now`` (the code that applies) and ``_ends``.

    ``_now`` is the slice's last valid send, or ``carried`` before the first
    one.  An attempt ends the code if it is expired (strictly after) or right.
    """
    upto = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = F.coalesce((F.col("kind") == "send") & (F.length("phone") == PHONE_LENGTH), F.lit(False))
    sent = F.when(valid, F.struct("code", F.col("_expires").alias("expires")))
    ev = events.withColumns({"_valid": valid, "_epoch": F.sum(valid.cast("int")).over(upto),
                             "_now": F.coalesce(F.last(sent, ignorenulls=True).over(upto), carried)})
    late = F.coalesce(F.col("ts") > F.col("_now.expires"), F.lit(False))
    right = F.coalesce(F.col("code") == F.col("_now.code"), F.lit(False))
    return ev.withColumns({"_late": late, "_ends": (F.col("kind") == "attempt") & (late | right)})


def _entering(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _state): the code that applies when a slice begins, null if there is none.

    A slice acts on the state like a small function: with a send, the state
    after it is its last code, unless an attempt behind that ended it, whatever
    came in; without one, the incoming code stays unless an attempt ends it.
    So its last send, whether that was ended, and the attempts before its first
    send (latest time, distinct codes) are all that later slices need, and the
    functions of a phone's slices are composed by two windows over one row a slice.
    """
    state = "struct<code:string,expires:timestamp_ntz>"
    rows = _with_state(events, keys, F.lit(None).cast(state))
    head = (F.col("_epoch") == 0) & (F.col("kind") == "attempt")
    slices = rows.groupBy(*keys).agg(
        F.max("_epoch").alias("_sends"), F.max_by("_now", "_epoch").alias("_last"),
        F.max(F.struct("_epoch", "_ends"))["_ends"].alias("_ended"),
        F.max(F.when(head, F.col("ts"))).alias("_head_ts"), F.collect_set(F.when(head, F.col("code"))).alias("_head_codes"))
    phone, place = keys[:2], keys[2:]
    before = Window.partitionBy(*phone).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    left = F.when(F.col("_sends") > 0, F.struct(F.col("_last").alias("sent"), F.col("_ended").alias("ended")))
    slices = slices.withColumns({"_in": F.last(left, ignorenulls=True).over(before),
                                 "_run": F.count(left).over(before)})
    ends = F.coalesce((F.col("_head_ts") > F.col("_in.sent.expires"))
                      | F.array_contains("_head_codes", F.col("_in.sent.code")), F.lit(False))
    run = Window.partitionBy(*phone, "_run").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max(ends).over(run), F.lit(False)) | F.coalesce(F.col("_in.ended"), F.lit(True))
    return slices.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)],
                         F.when(~gone, F.col("_in.sent")).alias("_state"))


def code_verification(events: DataFrame, ttl_seconds: int = CODE_TTL_SECONDS,
                      slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Verdict per send / attempt, equal to the per-phone state machine.

    A valid send (10-digit phone) replaces the code; an attempt finds no code
    ('not_requested'), an expired one ('expired', strictly after, which ends
    it), the right one ('verified', which ends it too) or a wrong one
    ('incorrect').  A phone's events are cut by day, and hot days further, so a
    flooded phone is many tasks; the state that enters each slice is composed
    from the slices before (``_entering``).  Events are shuffled once, by slice;
    the summaries and the verdicts read the same exchange.
    """
    ev = events.select("event_id", "phone", "kind", "ts", "code").withColumns(
        {"_day": F.date_trunc("day", "ts"), "_expires": plus_seconds("ts", ttl_seconds)})
    ev, keys = whole_keys(with_slice(ev, ["phone", "_day"], ["ts", "event_id"], slice_rows), ["phone", "_day", "_slice"], "_k")
    ev = ev.repartition(*keys)
    entering = _entering(ev, keys)
    rows = _with_state(ev.join(entering, same(keys, [f"_of{i}" for i in range(len(keys))]), "left"), keys, F.col("_state"))
    before = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    # epochs never decrease, so the largest (epoch, ended) so far tells whether the present one was ended
    last = F.max(F.struct("_epoch", "_ends")).over(before)
    rows = rows.withColumn("_before", last)
    ended = F.coalesce((F.col("_before._epoch") == F.col("_epoch")) & F.col("_before._ends"), F.lit(False))
    verdict = (F.when(F.col("kind") == "send", F.when(F.col("_valid"), "sent").otherwise("invalid_phone"))
                .when(F.col("_now").isNull() | ended, "not_requested")
                .when(F.col("_late"), "expired").when(F.col("_ends"), "verified").otherwise("incorrect"))
    return rows.where(F.col("kind").isin("send", "attempt")).select("event_id", "phone", "kind", "ts", verdict.alias("verdict"))


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def _seconds(span: str) -> int:
    """'7 days' -> 604800."""
    n, unit = span.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def slot_seconds(length: str, slide: str) -> int:
    """The longest step that both window and slide are multiples of: a window is whole slots."""
    return math.gcd(_seconds(length), _seconds(slide))


def sliding_sums(slots: DataFrame, length: str, slide: str) -> DataFrame:
    """(window_end, n_filed) of the windows with rows, from (slot, n_filed); slots begin at epoch multiples of their step.

    Each slot is added to the windows it lies in.  The table has one row a
    slot, so what is copied does not grow with the rows that were counted.
    """
    long, step, slot = _seconds(length), _seconds(slide), slot_seconds(length, slide)
    at = F.timestamp_diff("SECOND", ts_lit(EPOCH), F.col("slot"))
    # ends are multiples of the slide (plus the length) in (slot start, slot start + length], a whole slot before the end
    first = F.floor((at + slot - long + step - 1) / F.lit(step)) * step + long
    ends = F.sequence(first.cast("long"), (F.floor(at / F.lit(step)) * step + long).cast("long"), F.lit(step).cast("long"))
    return (slots.where("slot is not null").select(F.explode(ends).alias("e"), "n_filed").groupBy("e")
            .agg(F.sum("n_filed").alias("n_filed"))
            .select(plus_seconds(ts_lit(EPOCH), F.col("e")).alias("window_end"), "n_filed"))


def rolling_activity(m: Model, length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Complaints filed per trailing window, one row per window end (a series).

    One count per slot, then sums of slots: a complaint is counted once, not
    copied to every window it lies in.
    """
    slots = (m.complaints.groupBy(window_start("created_at", slot_seconds(length, slide)).alias("slot"))
             .agg(F.count(F.lit(1)).alias("n_filed")))
    return sliding_sums(slots, length, slide)
