"""R-05: composed transition functions equal the per-phone state machine, whatever the cuts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from civiccases.operators import timing

T, TTL = datetime(2024, 1, 1), 3600


def state_machine(rows: list[tuple]) -> dict[int, str]:
    state, out = {}, {}
    for i, phone, kind, ts, code in sorted(rows, key=lambda r: (r[3], r[0])):
        now = state.get(phone)
        if kind == "send":
            valid = phone is not None and len(phone) == 10
            out[i] = "sent" if valid else "invalid_phone"
            if valid:
                state[phone] = (code, ts + timedelta(seconds=TTL))
        elif now is None:
            out[i] = "not_requested"
        elif ts > now[1] or (code is not None and code == now[0]):
            out[i] = "expired" if ts > now[1] else "verified"
            del state[phone]
        else:
            out[i] = "incorrect"
    return out


def events(seed: int, n: int = 1500) -> list[tuple]:
    """A flooded phone, a quiet one that tries a code days later, ties in time, a bad and a null phone."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        phone = rng.choice(["9000000001"] * 6 + ["9000000002", "123", None, f"90000001{rng.randrange(10, 14)}"])
        kind = "send" if rng.random() < 0.15 else "attempt"
        ts = T + timedelta(minutes=rng.randrange(4 * 24 * 60) // 7 * 7)
        rows.append((i * 37 % 10_007, phone, kind, ts, rng.choice(["1", "2", "3", "4", None])))
    # days without a send between a code and its end, by expiry and (within its time) by the right code
    rows += [(20_000, "9000000009", "send", T, "7"), (20_001, "9000000009", "attempt", T + timedelta(days=2), "8"),
             (20_002, "9000000009", "attempt", T + timedelta(days=3), "7"),
             (20_010, "9000000008", "send", T + timedelta(hours=23, minutes=50), "7"),
             (20_011, "9000000008", "attempt", T + timedelta(days=1, minutes=1), "8"),
             (20_012, "9000000008", "attempt", T + timedelta(days=1, minutes=50), "7"),
             (20_013, "9000000008", "attempt", T + timedelta(days=1, minutes=50), "7"),
             (20_020, "9000000007", "send", T, "7"), (20_021, "9000000007", "attempt", T + timedelta(seconds=TTL), "7")]
    return rows


@pytest.mark.parametrize("seed,slice_rows", [(1, 10), (2, 60), (1, 1_000_000)])
def test_verdicts_equal_the_state_machine(spark, seed, slice_rows):
    rows = events(seed)
    df = spark.createDataFrame(rows, "event_id long, phone string, kind string, ts timestamp_ntz, code string").repartition(4)
    got = {r["event_id"]: r["verdict"] for r in timing.code_verification(df, TTL, slice_rows).collect()}
    assert got == state_machine(rows)
    assert {got[k] for k in (20_011, 20_012, 20_013)} == {"incorrect", "verified", "not_requested"}
    assert (got[20_001], got[20_002], got[20_021]) == ("expired", "not_requested", "verified")


def test_events_are_shuffled_once(spark):
    df = spark.createDataFrame(events(3), "event_id long, phone string, kind string, ts timestamp_ntz, code string")
    out = timing.code_verification(df, TTL)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("REPARTITION_BY_COL") - final.count("ReusedExchange") <= 1


def test_no_events(spark):
    df = spark.createDataFrame([], "event_id long, phone string, kind string, ts timestamp_ntz, code string")
    assert timing.code_verification(df, TTL).count() == 0
