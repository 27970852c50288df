"""Tool-call links and order against a plain version: chains, circles, ties, repeated ids and messages."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest

from civiccases.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def parsed(text):
    try:
        body = json.loads(text or "")
    except ValueError:
        return [], None, False
    if not isinstance(body, dict):
        return [], None, False
    calls = body.get("tool_calls")
    return calls or [], body.get("tool_call_id"), isinstance(calls, list)


def by_hand(rows: list[tuple]) -> Counter:
    """(conv, turn, role, text) -> order_turn, order_step, n_calls, n_answered, linked; messages one by one."""
    nodes = sorted(set(rows), key=repr)
    least = lambda t: -10 ** 9 if t is None else t
    made, of = defaultdict(set), {}
    for n in nodes:
        calls, result, _ = parsed(n[3])
        for c in calls:
            if c.get("id") is not None:
                made[n[0], c["id"]].add(n)
        if result is not None:
            of[n] = result
    digest = lambda n: n
    call, ambiguous = {}, set()
    for n, i in of.items():
        found = sorted(made[n[0], i], key=lambda c: (least(c[1]), digest(c)[2:]))
        before = [c for c in found if least(c[1]) <= least(n[1])]
        if found:
            turn = before[-1][1] if before else found[0][1]
            same = [c for c in found if c[1] == turn]
            ambiguous |= {n} if len(same) > 1 else set()
            call[n] = same[0]
    assert not ambiguous
    circle = set()
    for n in call:
        seen, at = [], n
        while at in call and at not in seen:
            seen.append(at)
            at = call[at]
        if at in seen:
            circle |= set(seen[seen.index(at):])
    bound = {n: c for n, c in call.items() if not (n in circle and least(c[1]) >= least(n[1]))}

    def place(n):
        if n not in bound:
            return n[1], 0
        turn, step = place(bound[n])
        return (n[1], 0) if least(n[1]) > least(turn) else (turn, step + 1)
    answered = defaultdict(set)
    for n, c in call.items():
        answered[c].add(of[n])
    return Counter((n[0], n[1], n[2], *place(n), len(parsed(n[3])[0]), len(answered[n]), n in call if n in of else None) for n in rows)


def conversation(rng: random.Random, conv, size: int) -> list[tuple]:
    """Messages at distinct turns in any order: calls with repeated ids, results of earlier and later calls, both in one."""
    rows = []
    for turn in rng.sample(range(size * 2), size):
        kind, body = rng.random(), {}
        if kind < 0.45:
            body["tool_calls"] = [{"id": rng.choice(["a", "b", "c", f"x{rng.randrange(size)}", None]), "name": "calculator",
                                   "arguments": {"expression": "1"}} for _ in range(rng.randint(1, 3))]
        if kind > 0.3:
            body["tool_call_id"] = rng.choice(["a", "b", "c", "nobody", f"x{rng.randrange(size)}"])
        body["n"] = turn
        rows.append((conv, turn, rng.choice(["tool", "assistant", None]), json.dumps(body) if rng.random() < 0.9 else "plain {"))
    return rows


def found(df) -> Counter:
    return Counter((r["conv_id"], r["turn"], r["role"], r["order_turn"], r["order_step"], r["n_calls"], r["n_answered"], r["linked"])
                   for r in chat.linked_messages(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_order_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = [r for c in [1, 2, 3, 4, 5, 6, None] for r in conversation(rng, c, rng.choice([3, 8, 25]))]
    rows += rng.sample(rows, 5)  # repeated messages
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA).repartition(3)
    got = found(df)
    assert got == by_hand(rows)
    assert max(k[4] for k in got) >= 1


def test_chain_against_the_turns(spark):
    """Call X at turn 5, its result calls Y at turn 1, Y's result at turn 2 and the one of that call at 0: X, then along the chain."""
    link = lambda n, result=None, *calls: json.dumps({"n": n} | ({"tool_call_id": result} if result else {}) | (
        {"tool_calls": [{"id": c, "name": "search", "arguments": {"query": "q"}} for c in calls]} if calls else {}))
    rows = [(1, 5, "assistant", link(5, None, "X")), (1, 1, "tool", link(1, "X", "Y")), (1, 2, "tool", link(2, "Y", "Z")), (1, 0, "tool", link(0, "Z")),
            (1, 9, "user", "bye"), (1, None, "user", "first"),
            (2, 1, "tool", link(1, "A", "B")), (2, 2, "tool", link(2, "B", "A")), (2, 3, "tool", link(3, "S", "S"))]
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA)
    got = {(r["conv_id"], r["turn"]): r for r in chat.linked_messages(df).collect()}
    order = sorted((k for k in got if k[0] == 1), key=lambda k: (got[k]["order_turn"] if got[k]["order_turn"] is not None else -1,
                                                                got[k]["order_step"], k[1] if k[1] is not None else -1))
    assert [k[1] for k in order] == [None, 5, 1, 2, 0, 9]
    assert [got[1, t]["n_answered"] for t in (5, 1, 2, 0)] == [1, 1, 1, 0] and all(got[1, t]["linked"] for t in (1, 2, 0))
    assert [(got[2, t]["order_turn"], got[2, t]["order_step"], got[2, t]["linked"]) for t in (1, 2, 3)] == [(1, 0, True), (2, 0, True), (3, 0, True)]
    assert found(df) == by_hand(rows)


def test_a_hot_id_is_cut(spark):
    """One id called and answered in every turn, in slices of 20 rows: each result has the call before it."""
    rows = [(7, 2 * t, "assistant", json.dumps({"tool_calls": [{"id": "call_0", "name": "search", "arguments": {"query": str(t)}}]})) for t in range(150)]
    rows += [(7, 2 * t + 1, "tool", json.dumps({"tool_call_id": "call_0", "content": t})) for t in range(150)]
    parts = chat.parsed_messages(spark.createDataFrame([(*r, "k") for r in rows], SCHEMA).repartition(4))
    calls = parts.where("calls is not null").selectExpr("conv_id", "'call_0' as call_id", "turn", "key")
    results = parts.where("result_of is not null").selectExpr("conv_id", "result_of as call_id", "turn", "key")
    got = {r["turn"]: r["call_turn"] for r in chat.linked_results(calls, results, slice_rows=20).collect()}
    assert got == {2 * t + 1: 2 * t for t in range(150)}
