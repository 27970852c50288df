"""J-20 / J-21: constraint and privacy audit, cascade purge.

The audit checks, as data, every constraint the reference's DDL declares
(keys, NOT NULL, foreign keys, enums, VARCHAR lengths) plus the open domains
given in its comments and the anonymity leak of decision D15.  Each table is
scanned twice: once for its row-local rules (one aggregate of conditional
counts) and once for the keys it owns and the keys it refers to.  All keys of
all tables meet in one group-by on (key space, key).  References are counted
before the shuffle, a bounded number of rows at a time, so a department with a
third of all complaints is a few rows a task; owned keys hardly repeat and are
sent as they are.  The shuffle has a part for each ``TASK_KEYS`` keys, so no
task's memory grows with the tables; unique keys, orphans and leaks are read
off the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.functions.expr import literal_table
from civiccases.sources.model import PRIORITIES, STATUSES, TABLES, Model

# Open domains from the DDL comments, and VARCHAR bounds.
ROLE_DOMAIN = ["officer", "supervisor", "collector", "admin"]
SOURCE_DOMAIN = ["web", "mobile", "whatsapp", "ivr"]
CHANNEL_DOMAIN = ["sms", "whatsapp", "push", "email"]
NOTIFICATION_STATUS_DOMAIN = ["sent", "failed", "delivered"]
FILE_TYPE_DOMAIN = ["image", "pdf", "video"]

VARCHAR_LIMITS = {
    "districts": {"name": 100, "name_te": 100, "code": 10},
    "mandals": {"name": 100, "name_te": 100},
    "departments": {"name": 150, "name_te": 150, "code": 20, "email": 200},
    "citizens": {"name": 200, "phone": 15, "email": 200, "aadhaar_hash": 64, "village": 200, "lang_pref": 5},
    "complaints": {"complaint_no": 30, "village": 200, "title": 300, "source": 20},
    "attachments": {"file_type": 50},
    "officers": {"name": 200, "email": 200, "phone": 15, "role": 30},
    "notifications": {"channel": 20, "status": 20},
}

NOT_NULL = {
    "districts": ["id", "name", "code"],
    "mandals": ["id", "name"],
    "departments": ["id", "name", "code"],
    "citizens": ["id", "name", "phone"],
    "complaints": ["id", "complaint_no", "department_id", "district_id", "title", "description"],
    "attachments": ["id", "file_url"],
    "officers": ["id", "name", "email"],
    "timeline": ["id", "status"],
    "notifications": ["id", "channel", "message"],
}

UNIQUE = {
    "districts": [["id"], ["code"]],
    "mandals": [["id"]],
    "departments": [["id"], ["code"]],
    "citizens": [["id"], ["phone"]],
    "complaints": [["id"], ["complaint_no"]],
    "attachments": [["id"]],
    "officers": [["id"], ["email"]],
    "timeline": [["id"]],
    "notifications": [["id"]],
    "upvotes": [["complaint_id", "voter_ip"]],
}

# (child table, child column, parent table) - the parent key is always ``id``.
FOREIGN_KEYS = [
    ("mandals", "district_id", "districts"),
    ("citizens", "district_id", "districts"),
    ("citizens", "mandal_id", "mandals"),
    ("complaints", "citizen_id", "citizens"),
    ("complaints", "department_id", "departments"),
    ("complaints", "district_id", "districts"),
    ("complaints", "mandal_id", "mandals"),
    ("complaints", "assigned_to", "officers"),
    ("attachments", "complaint_id", "complaints"),
    ("officers", "department_id", "departments"),
    ("officers", "district_id", "districts"),
    ("timeline", "complaint_id", "complaints"),
    ("timeline", "updated_by", "officers"),
    ("notifications", "complaint_id", "complaints"),
    ("notifications", "citizen_id", "citizens"),
]

DOMAINS = {
    ("complaints", "status"): STATUSES,
    ("complaints", "priority"): PRIORITIES,
    ("timeline", "status"): STATUSES,
    ("officers", "role"): ROLE_DOMAIN,
    ("complaints", "source"): SOURCE_DOMAIN,
    ("notifications", "channel"): CHANNEL_DOMAIN,
    ("notifications", "status"): NOTIFICATION_STATUS_DOMAIN,
    ("attachments", "file_type"): FILE_TYPE_DOMAIN,
}


def _row_rules(table: str) -> list[tuple[str, str, Column]]:
    """(rule, column, violation predicate) for the row-local rules of a table."""
    rules = []
    for col in NOT_NULL.get(table, []):
        rules.append(("not_null", col, F.col(col).isNull()))
    for col, limit in VARCHAR_LIMITS.get(table, {}).items():
        rules.append((f"max_length_{limit}", col, F.length(col) > limit))
    for (t, col), domain in DOMAINS.items():
        if t == table:
            rules.append(("domain", col, F.col(col).isNotNull() & ~F.col(col).isin(*domain)))
    return rules


def _table_checks(name: str, df: DataFrame) -> DataFrame:
    rules = _row_rules(name)
    aggs = [F.count(F.when(pred, F.lit(1))).alias(f"r{i}") for i, (_, _, pred) in enumerate(rules)]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{rule}', '{col}', r{i}" for i, (rule, col, _) in enumerate(rules))
    return one.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, column_name, n_violations)") \
              .select(F.lit(name).alias("table_name"), "rule", "column_name",
                      F.col("n_violations").cast("long").alias("n_violations"))


# A key space is a table's unique column set.  Slot 0 of a space counts the keys it owns, the
# further slots those of the rules that refer to it.
SPACES = [(table, tuple(cols)) for table, key_sets in UNIQUE.items() for cols in key_sets]
ANONYMITY = ("notifications", "complaint_id", "complaints", "citizen_id")


def _key_rules() -> list[tuple[int, int, str, str, str]]:
    """(space, slot, table_name, rule, column_name) of every rule on keys."""
    rules = [(i, 0, table, "unique", ",".join(cols)) for i, (table, cols) in enumerate(SPACES)]
    used = dict.fromkeys(range(len(SPACES)), 0)
    refs = [(child, f"foreign_key:{parent}", col, parent) for child, col, parent in FOREIGN_KEYS]
    refs.append((ANONYMITY[0], "anonymity_leak", ANONYMITY[3], ANONYMITY[2]))
    for child, rule, col, parent in refs:
        space = SPACES.index((parent, ("id",)))
        used[space] += 1
        rules.append((space, used[space], child, rule, col))
    return rules


#: keys that one task counts, and rows of a table whose references are counted together before the shuffle
TASK_KEYS, CHUNK_ROWS = 1_000_000, 200_000
SENT = pa.schema([("space", pa.int32()), ("slot", pa.int32()), ("number", pa.int64()), ("text", pa.string()),
                  ("anonymous", pa.bool_()), ("n", pa.int64())])


def _sender(sends: list[tuple[int, int, list[str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What sends the keys of a task's rows, ``CHUNK_ROWS`` rows at a time: its memory does not grow with the rows.

    ``sends`` has the key space, slot and key columns of each rule.  The
    functions are made here so that Spark sends them whole: executors need no
    copy of the package.
    """
    def sent(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for space, slot, names in sends:
            if slot:  # references count; a key that many rows refer to is one row
                found = pc.value_counts(rows[names[0]].combine_chunks().drop_null())
                number, n = found.field(0), found.field(1)
                text, anonymous = pa.nulls(len(n), pa.string()), pa.repeat(False, len(n))
            else:     # owned keys hardly repeat: they are sent as they come
                given = rows.filter(pc.and_(pc.is_valid(rows[names[0]]), pc.is_valid(rows[names[-1]])))
                n = pa.repeat(pa.scalar(1, pa.int64()), len(given))
                number, text = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.string())
                for c in names:
                    if pa.types.is_int64(given[c].type):
                        number = given[c].combine_chunks()
                    else:
                        text = given[c].combine_chunks().cast(pa.string())
                anonymous = given["anonymous"].combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(space, pa.int32()), len(n)),
                                              pa.repeat(pa.scalar(slot, pa.int32()), len(n)), number, text, anonymous, n],
                                             schema=SENT)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield from sent(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from sent(pa.Table.from_batches(held))

    return chunks


def _keys_of(name: str, df: DataFrame) -> tuple[DataFrame | None, int]:
    """One scan of a table: every key it owns or refers to; and how many a row has at most."""
    columns, sends = {"anonymous": F.lit(False)}, []
    for space, slot, table, rule, column in _key_rules():
        if table != name:
            continue
        names = []
        for c in SPACES[space][1] if rule == "unique" else [column]:
            key = F.col(c)
            if rule == "anonymity_leak":  # the complaint, where its caller is named
                key = F.when(F.col(column).isNotNull(), F.col(ANONYMITY[1]))
            names.append(f"k{space}_{slot}_{c}")
            columns[names[-1]] = key.cast("string" if df.schema[c].dataType.typeName() == "string" else "long")
        if (name, rule, column) == ("complaints", "unique", "id"):
            columns["anonymous"] = F.coalesce("is_anonymous", F.lit(False))
        sends.append((space, slot, names))
    if not sends:
        return None, 0
    return (df.select(*[c.alias(k) for k, c in columns.items()])
            .mapInArrow(_sender(sends), "space int, slot int, number long, text string, anonymous boolean, n long")), len(sends)


def _key_checks(m: Model) -> DataFrame:
    """All rules on keys: unique keys seen twice, references without an owner, callers of anonymous complaints."""
    rules = _key_rules()
    sent, most = None, 0
    for name in TABLES:
        part, a_row = _keys_of(name, getattr(m, name))
        if part is not None:
            sent = part if sent is None else sent.unionByName(part)
            most += a_row * m.rows(name)
    slots = range(max(slot for _, slot, *_ in rules) + 1)
    keys = ["space", "number", "text"]
    # as many parts as the keys need: the session's number would give a task ever more of them
    groups = sent.repartition(max(1, -(-most // TASK_KEYS)), *keys).groupBy(*keys).agg(
        F.max("anonymous").alias("anonymous"),
        *[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(F.lit(0))).alias(f"n{i}") for i in slots])
    leak = next((space, slot) for space, slot, _, rule, _ in rules if rule == "anonymity_leak")

    def violations(slot: int) -> Column:
        if slot == 0:
            return F.when(F.col("n0") > 1, F.lit(1)).otherwise(F.lit(0))
        orphans = F.when(F.col("n0") == 0, F.col(f"n{slot}")).otherwise(F.lit(0))
        if slot != leak[1]:
            return orphans
        return F.when(F.col("space") == leak[0], F.when(F.col("anonymous"), F.col(f"n{slot}")).otherwise(F.lit(0))
                      ).otherwise(orphans)

    totals = groups.groupBy("space").agg(*[F.sum(violations(i)).alias(f"v{i}") for i in slots])
    found = totals.select(F.col("space").alias("_space"), F.posexplode(F.array(*[f"v{i}" for i in slots])).alias(
        "_slot", "_n"))
    known = literal_table(m.complaints.sparkSession, rules,
                          "space int, slot int, table_name string, rule string, column_name string")
    return (known.join(found, (F.col("space") == F.col("_space")) & (F.col("slot") == F.col("_slot")), "left")
            .select("table_name", "rule", "column_name",
                    F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_violations")))


def constraint_audit(m: Model, only_violations: bool = False) -> DataFrame:
    """One row per rule: (table_name, rule, column_name, n_violations)."""
    parts = [_table_checks(name, getattr(m, name)) for name in NOT_NULL]
    parts.append(_key_checks(m))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("n_violations") > 0) if only_violations else out


# ------------------------------------------------------------------ J-21

def cascade_purge(m: Model, purge_ids: DataFrame) -> DataFrame:
    """Outcome per requested complaint id.

    Attachments and timeline rows cascade; notifications do not, so a
    complaint that has any is refused (the delete would fail its FK).
    """
    req = purge_ids.select(F.col(purge_ids.columns[0]).alias("complaint_id")).distinct()
    known = m.complaints.select(F.col("id").alias("_id"))
    # children are cut to the purge set first (a semi join; broadcast when the set is small)
    def per(df: DataFrame, alias: str, n: str) -> DataFrame:
        hit = df.join(req.select(F.col("complaint_id").alias("_r")), F.col("complaint_id") == F.col("_r"),
                      "left_semi")
        return hit.groupBy(F.col("complaint_id").alias(alias)).agg(F.count(F.lit(1)).alias(n))

    att = per(m.attachments, "_a", "_na")
    tl = per(m.timeline, "_t", "_nt")
    notes = per(m.notifications, "_n", "_nn")
    j = (req.join(known, F.col("complaint_id") == F.col("_id"), "left")
            .join(att, F.col("complaint_id") == F.col("_a"), "left")
            .join(tl, F.col("complaint_id") == F.col("_t"), "left")
            .join(notes, F.col("complaint_id") == F.col("_n"), "left"))
    outcome = (F.when(F.col("_id").isNull(), F.lit("not_found"))
                .when(F.coalesce(F.col("_nn"), F.lit(0)) > 0, F.lit("refused_notifications"))
                .otherwise(F.lit("purged")))
    purged = outcome == "purged"
    return j.select("complaint_id", outcome.alias("outcome"),
                    F.when(purged, F.coalesce(F.col("_na"), F.lit(0))).otherwise(F.lit(0)).cast("long")
                     .alias("attachments_removed"),
                    F.when(purged, F.coalesce(F.col("_nt"), F.lit(0))).otherwise(F.lit(0)).cast("long")
                     .alias("timeline_removed"))


def apply_purge(m: Model, purge_ids: DataFrame) -> Model:
    """The snapshot after the purge: purged complaints and their cascaded rows removed."""
    verdict = cascade_purge(m, purge_ids).filter(F.col("outcome") == "purged").select(F.col("complaint_id").alias("_p"))
    drop = lambda df, col: df.join(verdict, F.col(col) == F.col("_p"), "left_anti")
    return m.replace(complaints=drop(m.complaints, "id"), attachments=drop(m.attachments, "complaint_id"),
                     timeline=drop(m.timeline, "complaint_id"))
