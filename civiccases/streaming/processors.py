"""Stateful processors for ``transformWithState`` (R-03) and ``transformWithStateInPandas`` (R-05).

Python runs here per key and micro-batch; the rows of a key arrive in any
order.  The code verifier sorts the rows of one phone in pandas.  The vote
processors take plain rows one by one, since most of their keys have one row and
a data frame a key would cost more than the row; they keep what is first, so
they never hold all rows of a key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CODE_OUTPUT = "event_id long, phone string, kind string, ts timestamp, verdict string"
#: kind: 'reject' (a vote and its reason), 'first' (one of a shard's first accepted votes), 'total' (accepted votes
#: of a shard), the last two with the complaint's stored count and priority; times are microseconds.
#: (target, part) is the second step's key: the complaint and 0, for refused votes no complaint and their shard
VERDICT_OUTPUT = ("target long, part int, kind string, complaint_id long, vote_id long, reason string, n long, base_count int, "
                  "priority string, at long")
#: kind: 'reject', 'count' (new votes of a complaint and its count after them), 'crossed' (the vote that crossed)
VOTE_OUTPUT = ("kind string, complaint_id long, vote_id long, reason string, new_votes long, upvote_count int, "
               "at long")
NO_COMPLAINT = -1
UNKNOWN_NUMBER, ALREADY = "Complaint not found", "Already upvoted"
Verdict, Vote = (Row(*[column.split()[0] for column in schema.split(", ")]) for schema in (VERDICT_OUTPUT, VOTE_OUTPUT))


class CodeVerifier(StatefulProcessor):
    """Per phone: the current code and its expiry (ValueState); one-time, strictly-after expiry.

    ``forget``: seconds after its expiry from which a code is as if it had
    never been sent; an event-time timer then removes its state.  None keeps
    an unused code for ever (and needs no timers).
    """

    def __init__(self, ttl_seconds: int, phone_length: int = 10, forget: int | None = None):
        self.ttl = pd.Timedelta(seconds=ttl_seconds)
        self.phone_length = phone_length
        self.forget = None if forget is None else timedelta(seconds=forget)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.code = handle.getValueState("code", "code string, expires timestamp")

    def _forgotten(self, expires, now) -> bool:
        return self.forget is not None and now > pd.Timestamp(expires) + self.forget

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        before = current = self.code.get() if self.code.exists() else None
        verdicts = []
        for kind, phone, code, ts in zip(batch["kind"], batch["phone"], batch["code"], batch["ts"]):
            if current is not None and self._forgotten(current[1], ts):
                current = None
            if kind == "send":
                if phone is not None and len(phone) == self.phone_length:
                    current = (code, ts + self.ttl)
                    verdicts.append("sent")
                else:
                    verdicts.append("invalid_phone")
            elif current is None:
                verdicts.append("not_requested")
            elif ts > pd.Timestamp(current[1]):
                current = None
                verdicts.append("expired")
            elif code != current[0]:
                verdicts.append("incorrect")
            else:
                current = None
                verdicts.append("verified")
        if current is None:
            if before is not None:
                self.code.clear()
        elif current is not before:
            expires = pd.Timestamp(current[1])
            self.code.update((current[0], expires.to_pydatetime()))
            if self.forget is not None:
                self.handle.registerTimer(int((expires + self.forget).value // 10 ** 6) + 1)
        yield pd.DataFrame({"event_id": batch["event_id"].astype("int64"), "phone": batch["phone"],
                            "kind": batch["kind"], "ts": batch["ts"], "verdict": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A timer of an older code finds a newer one and leaves it."""
        if self.code.exists():
            due = int((pd.Timestamp(self.code.get()[1]) + self.forget).value // 10 ** 6) + 1
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.code.clear()
        return iter([])

    def close(self) -> None:
        pass


class VoteUniqueness(StatefulProcessor):
    """First step, keyed by (complaint, shard of voters): who has voted (MapState, for ever).

    Emits every refused vote, the first ``threshold`` accepted ones and their
    number: a few rows a shard and micro-batch, whatever the votes.  A
    complaint with a third of all votes is as many keys as there are shards.
    Votes that are refused whatever the state (an unknown number, a stored
    voter) come under ``NO_COMPLAINT`` with their reason and pass.
    """

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.voters = handle.getMapState("voters", "voter_ip string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        complaint, part = key[0], 1 + key[1]

        def refused(of: int, vote: int, reason: str, at: int) -> Row:
            return Verdict(NO_COMPLAINT, part, "reject", of, vote, reason, None, None, None, at)

        if complaint == NO_COMPLAINT:
            for r in rows:
                yield refused(r["target"], r["vote_id"], r["reason"], r["at"])
            return
        first: dict[str, tuple] = {}  # voter -> their earliest vote of this batch
        for r in rows:
            voter, me = r["voter_ip"], (r["at"] is not None, r["at"], r["vote_id"])
            best = first.get(voter)
            if best is None:
                first[voter] = me
                known = r["base_count"], r["priority"]
                continue
            if me < best:
                first[voter], me = me, best
            yield refused(complaint, me[2], ALREADY, me[1])
        accepted = []
        for voter, me in first.items():
            if self.voters.containsKey((voter,)):
                yield refused(complaint, me[2], ALREADY, me[1])
            else:
                self.voters.updateValue((voter,), (True,))
                accepted.append(me)
        for _, at, vote in heapq.nsmallest(self.threshold, accepted):
            yield Verdict(complaint, 0, "first", complaint, vote, None, None, *known, at)
        if accepted:
            yield Verdict(complaint, 0, "total", complaint, None, None, len(accepted), *known, None)

    def close(self) -> None:
        pass


class VoteTotals(StatefulProcessor):
    """Second step, keyed by (complaint, 0): the complaint's count and priority (ValueState).

    A complaint holds its shards' totals and first votes: at most threshold + 1
    rows a shard and micro-batch, and one state read and write.  A vote that
    takes a 'normal' complaint to >= threshold raises it to 'high' once
    ('crossed').  Under ``NO_COMPLAINT`` refused votes pass, by shard.
    """

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.info = handle.getValueState("info", "upvote_count int, priority string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        complaint = key[0]
        if complaint == NO_COMPLAINT:
            for r in rows:
                yield Vote("reject", r["complaint_id"], r["vote_id"], r["reason"], None, None, r["at"])
            return
        new, firsts = 0, []
        for r in rows:
            count, priority = r["base_count"], r["priority"]
            if r["kind"] == "total":
                new += r["n"]
            else:
                firsts.append((r["at"] is not None, r["at"], r["vote_id"]))
        if self.info.exists():
            count, priority = self.info.get()
        count = count or 0
        crossing = max(1, self.threshold - count)  # the position of the vote that reaches the threshold
        if priority == "normal" and crossing <= new:
            _, at, vote = heapq.nsmallest(crossing, firsts)[-1]
            yield Vote("crossed", complaint, vote, None, None, count + crossing, at)
            priority = "high"
        yield Vote("count", complaint, None, None, new, count + new, None)
        self.info.update((count + new, priority))

    def close(self) -> None:
        pass
