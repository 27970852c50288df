"""Chat formatting: tool calls linked to their results, ordered, validated, serialised as canonical JSON.

A message's text is an object with ``tool_calls`` ([{"id", "name",
"arguments"}], assistant) or with ``tool_call_id`` (a result, role tool);
anything else is plain content.  A message may be both.

Links: calls and results meet in a hash join on (conversation, id).  An id that
is called again links a result to the latest call before it (in the order of
turns), or to the first one if all come later.

Order: a message comes at its turn, a result never before its call.  Places
(turn, step) are propagated along the chains of calls and results until nothing
moves: a result whose call's place is later takes the call's turn, one step on.
Only results take part, one row each; a conversation is never collected.  Links
that close a circle (two messages that answer each other) bind nothing where
they lead to a later or equal turn; everything else keeps its order.

Canonical JSON: object keys sorted, no white space, numbers as parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.llm.common import clean_text, saved
from civiccases.plans.slices import SLICE_ROWS, with_slice

#: tool -> argument -> (type, required); types: string, integer, number, boolean, object, array
Schemas = dict[str, dict[str, tuple[str, bool]]]
SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "timeout": ("number", False)},
}
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
          "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def _field(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def argument_error(name: Column, args: Column, schemas: Schemas) -> Column:
    """Null if the arguments fit their tool's schema, else what is wrong first (tools and arguments in given order)."""
    out = F.lit("unknown tool")
    for tool, fields in schemas.items():
        checks = [F.when(~F.coalesce(F.startswith(F.schema_of_variant(args), F.lit("OBJECT")), F.lit(False)),
                         "arguments are no object")]
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(_field(args, f"$['{field}']"))
            if required:
                checks.append(F.when(got.isNull(), f"{field} is missing"))
            fits = F.lit(False)
            for prefix in _TYPES[kind]:
                fits = fits | F.startswith(got, F.lit(prefix))
            checks.append(F.when(got.isNotNull() & ~fits, f"{field} is not {kind}"))
        out = F.when(name == tool, F.coalesce(*checks, F.lit(None).cast("string"))).otherwise(out)
    return out


def parsed_messages(conversations: DataFrame) -> DataFrame:
    """Messages with ``body`` (variant, null for plain text), ``calls`` (array), ``result_of`` (id) and ``key``.

    ``key`` is a digest of role and text: rows that agree in conversation, turn
    and key are one message, however often they are repeated.
    """
    text = clean_text("text")
    body = F.when(F.rlike(text, F.lit(r"\A\s*\{")), F.try_parse_json(text))
    return (conversations.select("conv_id", "turn", "role", F.col("text").alias("content"), body.alias("body"),
                                 F.md5(F.to_json(F.struct("role", "text"))).alias("key"))
            .withColumn("calls", _field(F.col("body"), "$.tool_calls", "array<variant>"))
            .withColumn("result_of", _field(F.col("body"), "$.tool_call_id", "string")))


# --- links ---------------------------------------------------------------------------------

def linked_results(calls: DataFrame, results: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conv_id, call_id, turn, key, call_turn, call_key) of the results that have a call.

    calls and results: (conv_id, call_id, turn, key).  The latest call at or
    before the result's turn, by a running last value; else the id's first call.
    An id with very many calls and results is cut into slices along its turns,
    and what a slice begins with is carried from the slices before.
    """
    rows = (calls.withColumn("is_result", F.lit(0)).unionByName(results.withColumn("is_result", F.lit(1)))
            .withColumn("at", F.coalesce("turn", F.lit(-2 ** 63))))
    cell = ["conv_id", "call_id"]
    rows = with_slice(rows, cell, ["at", "is_result", "key"], slice_rows)
    call = F.when(F.col("is_result") == 0, F.struct("turn", "key"))
    # the carried call is a grouped value: one row a slice
    ends = rows.groupBy(*cell, "_slice").agg(F.max(F.when(F.col("is_result") == 0, F.struct("at", "key", "turn"))).alias("last"),
                                             F.min(F.when(F.col("is_result") == 0, F.struct("at", "key", "turn"))).alias("first"))
    before = Window.partitionBy(*cell).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_id"), F.col("_slice").alias("_of"),
                       F.last("last", ignorenulls=True).over(before).alias("carried"),
                       F.min("first").over(Window.partitionBy(*cell)).alias("first"))
    same = (F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_id")) & (F.col("_slice") == F.col("_of")))
    order = Window.partitionBy(*cell, "_slice").orderBy("at", "is_result", "key").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(ends, same).withColumn("own", F.last(call, ignorenulls=True).over(order)).where("is_result = 1")

    def part(name: str) -> Column:
        return F.when(F.col("own").isNotNull(), F.col(f"own.{name}")).when(
            F.col("carried").isNotNull(), F.col(f"carried.{name}")).otherwise(F.col(f"first.{name}"))

    return found.where("first is not null").select(
        "conv_id", "call_id", "turn", "key", part("turn").alias("call_turn"), part("key").alias("call_key"))


# --- order ---------------------------------------------------------------------------------

def _node(conv: str = "conv_id", turn: str = "turn", key: str = "key") -> Column:
    return F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(key).alias("key"))


def without_circles(links: DataFrame) -> DataFrame:
    """``links`` (me, call: nodes) without those inside a circle that lead to a later or equal turn.

    Pointers are doubled until the number of nodes that still point somewhere
    stops shrinking: chains have ended by then, and what is pointed to lies on circles.
    """
    ahead, left = saved(links.select("me", F.col("call").alias("to")), "ahead"), None
    while True:
        now = ahead.count()
        if not now:
            return links
        if now == left:
            break
        left = now
        step = ahead.select(F.col("me").alias("_at"), F.col("to").alias("_next"))
        ahead = saved(ahead.join(step, F.col("to") == F.col("_at")).select("me", F.col("_next").alias("to")), "ahead")
    on_circle = ahead.select(F.col("to").alias("_on")).distinct()
    closing = (links.join(on_circle, F.col("me") == F.col("_on"), "left_semi")
               .where(F.coalesce(F.col("call.turn") >= F.col("me.turn"), F.lit(True))).select(F.col("me").alias("_cut")))
    return saved(links.join(closing, F.col("me") == F.col("_cut"), "left_anti"), "links")


def places(links: DataFrame) -> DataFrame:
    """(me, order_turn, order_step) of every linked result; one whose link is cut stays at its own turn.

    A round looks up the places that the calls' messages have so far (their own
    turn and step 0 if they are no results) and stops when no place has moved.
    """
    every, links = links.select("me"), without_circles(links)
    now = saved(links.select("me", F.col("me.turn").alias("order_turn"), F.lit(0).alias("order_step")), "places")
    while True:
        called = now.select(F.col("me").alias("_at"), F.col("order_turn").alias("_turn"), F.col("order_step").alias("_step"))
        turn, step = F.coalesce("_turn", "call.turn"), F.coalesce("_step", F.lit(0))
        behind = F.col("me.turn").isNotNull() & F.coalesce(F.col("me.turn") > turn, F.lit(True))
        new = saved(links.join(called, F.col("call") == F.col("_at"), "left").select(
            "me", F.when(behind, F.col("me.turn")).otherwise(turn).alias("order_turn"),
            F.when(behind, 0).otherwise(step + 1).alias("order_step")), "places")
        old = now.select(F.col("me").alias("_at"), F.col("order_turn").alias("_turn"), F.col("order_step").alias("_step"))
        moved = new.join(old, F.col("me") == F.col("_at")).where(
            ~F.col("order_turn").eqNullSafe(F.col("_turn")) | (F.col("order_step") != F.col("_step")))
        now = new
        if moved.isEmpty():
            break
    still = every.join(now.select(F.col("me").alias("_at")), F.col("me") == F.col("_at"), "left_anti")
    return now.unionByName(still.select("me", F.col("me.turn").alias("order_turn"), F.lit(0).alias("order_step")))


# --- the operator --------------------------------------------------------------------------

def linked_messages(conversations: DataFrame, schemas: Schemas = SCHEMAS) -> DataFrame:
    """One row per message, with its order, links, first invalid call and canonical JSON.

    conv_id, turn, role, order_turn, order_step (0: at its own turn, n: n links
    behind a message of that turn), n_calls, n_answered (distinct call ids of
    the message with a result), linked (null if the message is no result, else
    whether its call exists), call_error, json.  (order_turn, order_step, turn)
    is the order; messages that tie there depend on nothing of each other.

    Null text is null content; null roles and turns stay null (a null turn comes
    first).  Broken JSON is plain content.  A call without id links with
    nothing; messages without conversation link among themselves.  Repeated rows
    give repeated messages.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    rows = parsed_messages(conversations)
    calls = (rows.where("calls is not null").select("conv_id", "turn", "key", F.explode("calls").alias("call"))
             .select("conv_id", _field(F.col("call"), "$.id", "string").alias("call_id"), "turn", "key")
             .where("call_id is not null").distinct())
    results = rows.where("result_of is not null").select("conv_id", F.col("result_of").alias("call_id"), "turn", "key").distinct()
    links = saved(linked_results(calls, results), "results")
    me, call = _node(), _node(turn="call_turn", key="call_key")
    placed = places(saved(links.select(me.alias("me"), call.alias("call")), "links"))
    answered = (links.select(call.alias("node"), "call_id").distinct().groupBy("node")
                .agg(F.count(F.lit(1)).alias("_answered")).select("node", "_answered"))
    # plain messages skip the joins
    tied = rows.where("result_of is not null or calls is not null").withColumn("node", me)
    tied = (tied.join(answered, "node", "left").join(placed.withColumnRenamed("me", "node"), "node", "left")
            .select(*rows.columns, "order_turn", "order_step", "_answered"))
    plain = rows.where("result_of is null and calls is null").select(
        *rows.columns, F.lit(None).cast("long").alias("order_turn"), F.lit(None).cast("int").alias("order_step"),
        F.lit(None).cast("long").alias("_answered"))
    every = plain.unionByName(tied)
    is_linked = F.col("order_step").isNotNull()
    errors = F.filter(F.transform("calls", lambda c: argument_error(
        _field(c, "$.name", "string"), _field(c, "$.arguments"), schemas)), lambda e: e.isNotNull())
    return every.select(
        "conv_id", "turn", "role", F.when(is_linked, F.col("order_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.coalesce("order_step", F.lit(0)).alias("order_step"),
        F.when(F.col("calls").isNull(), 0).otherwise(F.size("calls")).alias("n_calls"),
        F.coalesce("_answered", F.lit(0).cast("long")).alias("n_answered"),
        F.when(F.col("result_of").isNotNull(), is_linked).alias("linked"),
        F.get(errors, F.lit(0)).alias("call_error"),
        canonical_json().alias("json"))


def canonical_json() -> Column:
    """{"content": ..., "role": ...}; content is the parsed object (sorted keys) if the text is one, else the text."""
    parsed = F.to_json(F.col("body"))
    text = F.when(F.col("content").isNull(), F.lit("null")).otherwise(_json_string(F.col("content")))
    role = F.when(F.col("role").isNull(), F.lit("null")).otherwise(_json_string(F.col("role")))
    return F.concat(F.lit('{"content":'), F.coalesce(parsed, text), F.lit(',"role":'), role, F.lit("}"))


def _json_string(text: Column) -> Column:
    wrapped = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
