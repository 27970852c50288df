"""The driver's TPC-H-like testdata, read as the complaints model (FIXTURES.md 2).

One place only: every rule that turns ``orders``/``lineitem``/``events``/...
into complaints, timeline rows, votes and requests lives here, and the DuckDB
oracle (``civiccases.oracle.sql``) states the same rules in SQL.  All reads
are column-pruned parquet scans; dimensions derived from ``nation`` (25 rows
by definition) and the 10 seed departments are the only explicit broadcasts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiccases.functions.expr import overdue_at, plus_days, plus_seconds, ts_lit
from civiccases.plans.ranking import bucket_of, global_rank
from civiccases.plans.slices import parts_for
from civiccases.sources.model import SCHEMAS, Model, seed_departments

# Fixture constants (ours, not the reference's).
AS_OF = datetime(2001, 8, 1, 12, 0, 0)
VOTE_CUTOFF = datetime(2024, 1, 16, 0, 0, 0)       # votes before: stored; after: requests
UPLOAD_BASE = datetime(2001, 7, 1, 0, 0, 0)
REGISTRATION_BASE = datetime(2001, 8, 1, 0, 0, 0)
INACTIVE_DEPARTMENT = 9
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
DISTRICT_MOD = 24            # district 24 stays empty
HOT_VOTE_SHARE = 30          # three of four votes go to every 30th part of the complaints
FILE_SHARE = 375             # files belong to every 375th part of the complaints
NO_MESSAGES = 5              # every 5th caller gets no messages
UNKNOWN_ID_OFFSET = 10 ** 9
UNKNOWN_OFFICER_OFFSET = 1_000_000
LINE_STATUSES = ["acknowledged", "assigned", "in_progress", "resolved", "rejected", "closed"]
OFFICER_ROLES = ["officer", "supervisor", "collector", "admin"]
TEST_CODE = "482910"
TEST_CODE_TTL_SECONDS = 86400


def _read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


#: the table whose rows a table of the model is made of, one or fewer of each
MADE_OF = {"citizens": ("customer", "c_custkey"), "officers": ("supplier", "s_suppkey"),
           "complaints": ("orders", "o_orderkey"), "notifications": ("orders", "o_orderkey"),
           "timeline": ("lineitem", "l_orderkey"), "attachments": ("pages", "page_id"), "upvotes": ("events", "event_id")}


def _rows_of(spark: SparkSession, sf_dir: str, table: str, column: str) -> int:
    return _read(spark, sf_dir, table, column).count()


def _dealt(df: DataFrame, n_rows: int, key: str) -> DataFrame:
    """The side of a join on ``key`` that says by its parts how many tasks join the other side's ``n_rows``."""
    parts = parts_for(df.sparkSession, n_rows)
    return df.repartition(parts, key) if parts else df


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def segment_index(segment: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), segment).cast("int") - F.lit(1)


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return n.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"),
                    F.lit(None).cast("string").alias("name_te"),
                    F.format_string("D%02d", F.col("n_nationkey")).alias("code"))


def mandals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation", "n_nationkey")
    seg = F.posexplode(F.array(*[F.lit(s) for s in SEGMENTS])).alias("pos", "name")
    return (n.select("n_nationkey", seg)
             .select((F.col("n_nationkey") * 5 + F.col("pos")).cast("int").alias("id"),
                     F.col("n_nationkey").cast("int").alias("district_id"), "name",
                     F.lit(None).cast("string").alias("name_te")))


def citizens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    district = (F.col("c_nationkey") % DISTRICT_MOD).cast("int")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.format_string("9%09d", F.col("c_custkey")).alias("phone"),
        F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("aadhaar_hash"),
        district.alias("district_id"),
        (district * 5 + segment_index(F.col("c_mktsegment"))).cast("int").alias("mandal_id"),
        F.lit(None).cast("string").alias("village"),
        F.when(F.col("c_custkey") % 2 == 0, "te").otherwise("en").alias("lang_pref"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_login"))


def officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    return s.select(
        k.cast("int").alias("id"), F.col("s_name").alias("name"),
        F.format_string("officer%d@civicdesk.example.org", k).alias("email"),
        F.format_string("8%09d", k).alias("phone"),
        (k % 10 + 1).cast("int").alias("department_id"),
        (F.col("s_nationkey") % DISTRICT_MOD).cast("int").alias("district_id"),
        _pick(k % 4, OFFICER_ROLES).alias("role"),
        (k % 9 != 0).alias("is_active"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_login"))


def departments(spark: SparkSession) -> DataFrame:
    """The seed departments, with department 9 switched off (exercises the active-only reports)."""
    return seed_departments(spark).withColumn("is_active", F.col("id") != F.lit(INACTIVE_DEPARTMENT))


def _vote_target(spark: SparkSession, sf_dir: str) -> Column:
    """The complaint an event votes for: any of all, three times in four one of a share that grows with them."""
    n = _read(spark, sf_dir, "orders", "o_orderkey").count()
    key = F.col("event_id") * 7 + F.col("user_id")
    return F.when(F.col("event_id") % 4 == 0, key % max(n, 1)).otherwise(key % max(n // HOT_VOTE_SHARE, 1))


def _existing_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stored vote per (complaint, voter): click/view events before the cutoff."""
    e = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    votes = (e.filter(F.col("event_type").isin("click", "view") & (F.col("ts") < ts_lit(VOTE_CUTOFF)))
              .select(_vote_target(spark, sf_dir).alias("complaint_id"),
                      F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("voter_ip"),
                      F.struct("ts", "event_id").alias("k")))
    first = votes.groupBy("complaint_id", "voter_ip").agg(F.min("k").alias("k"))
    return first.select(F.col("k.event_id").alias("id"), "complaint_id", "voter_ip",
                        F.col("k.ts").alias("voted_at"))


def upvotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _existing_votes(spark, sf_dir)


def _complaint_base(spark: SparkSession, sf_dir: str, as_of: datetime) -> DataFrame:
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
              "o_orderpriority")
    n_docs = _read(spark, sf_dir, "documents", "doc_id").count()
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    deps = F.broadcast(seed_departments(spark).select(F.col("id").alias("_dep"), "sla_days"))
    key = F.col("o_orderkey")
    district = (F.col("c_nationkey") % DISTRICT_MOD).cast("int")
    done_at = plus_seconds(plus_days("o_orderdate", F.lit(1) + key % 20), F.col("o_custkey") % 86400)
    status = (F.when((F.col("o_orderstatus") == "F") & (done_at <= ts_lit(as_of)),
                     F.when(key % 5 == 0, "closed").otherwise("resolved"))
               .when((F.col("o_orderstatus") == "P") & (key % 6 == 0), "rejected")
               .when(F.col("o_orderstatus") == "O",
                     _pick(key % 4, ["submitted", "acknowledged", "assigned", "in_progress"]))
               .otherwise("in_progress"))
    j = (o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
          .withColumn("department_id", ((key + F.col("o_custkey")) % 9 + 1).cast("int"))
          .join(deps, F.col("department_id") == F.col("_dep"), "left")
          .withColumn("status", status)
          .withColumn("done_at", done_at))
    anonymous = key % 7 == 0
    finished = F.col("status").isin("resolved", "closed")
    return j.select(
        key.alias("id"),
        F.when(anonymous, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("citizen_id"),
        "department_id",
        district.alias("district_id"),
        F.when(key % 5 == 0, F.lit(None).cast("int"))
         .otherwise(district * 5 + segment_index(F.col("c_mktsegment"))).cast("int").alias("mandal_id"),
        F.lit(None).cast("string").alias("village"),
        F.concat(F.lit("Case "), key.cast("string")).alias("title"),
        (key % max(n_docs, 1)).alias("_doc"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "emergency")
         .when(F.col("o_orderpriority") == "2-HIGH", "urgent").otherwise("normal").alias("priority"),
        F.lit(None).cast("decimal(10,8)").alias("latitude"),
        F.lit(None).cast("decimal(11,8)").alias("longitude"),
        F.lit(None).cast("string").alias("address"),
        "status",
        F.when(F.col("status").isin("assigned", "in_progress", "resolved", "closed"),
               (key % 10).cast("int")).alias("assigned_to"),
        F.when(key % 101 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(plus_days("o_orderdate", F.coalesce(F.nullif("sla_days", F.lit(0)), F.lit(7))))
         .alias("sla_deadline"),
        anonymous.alias("is_anonymous"),
        F.lit("web").alias("source"),
        F.col("o_orderdate").alias("created_at"),
        F.when(finished, F.col("done_at")).otherwise(F.col("o_orderdate")).alias("updated_at"),
        F.when(finished, F.col("done_at")).alias("resolved_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        F.col("department_id").isin(1, 2, 3, 5, 6).alias("is_public"),
        (key % 13 == 0).alias("_null_votes"),
        (key % 11 == 0).alias("_null_flag"),
        (key % 3 == 0).alias("_flag_set"))


def brief_complaints(spark: SparkSession, sf_dir: str, as_of: datetime = AS_OF,
                     dists: DataFrame | None = None) -> DataFrame:
    """The complaints with the id of their text in place of the description."""
    base = _complaint_base(spark, sf_dir, as_of)
    dists = dists if dists is not None else districts(spark, sf_dir)
    votes = (_existing_votes(spark, sf_dir).groupBy("complaint_id")
             .agg(F.count(F.lit(1)).cast("int").alias("_votes")))
    codes = dists.select(F.col("id").alias("_did"), F.col("code").alias("_dcode"))
    live = overdue_at(as_of)
    j = (base
         .join(votes, F.col("id") == F.col("complaint_id"), "left")
         .join(codes, F.col("district_id") == F.col("_did"), "left")
         .withColumn("is_overdue", F.when(F.col("_null_flag"), F.lit(None).cast("boolean"))
                     .otherwise(F.col("_flag_set") & F.coalesce(live, F.lit(False))))
         .withColumn("upvote_count", F.coalesce(
             F.col("_votes"), F.when(F.col("_null_votes"), F.lit(None).cast("int")).otherwise(F.lit(0)))))
    numbered = global_rank(j, bucket_of("created_at", "day"), ["created_at", "id"], "_seq",
                           n_rows=_rows_of(spark, sf_dir, *MADE_OF["complaints"]))
    numbered = numbered.withColumn(
        "complaint_no", F.concat_ws("-", F.lit("AP"), F.year("created_at").cast("string"), F.col("_dcode"),
                                    F.format_string("%05d", F.col("_seq"))))
    return numbered.select(*[f.name for f in SCHEMAS["complaints"] if f.name != "description"], "_doc")


def with_description(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` of brief complaints with their text; the numbering and other joins come first, so that they move no text."""
    # Grouped by doc_id so the key is known unique: when no report reads the
    # description, Catalyst removes this join altogether.
    docs = (_read(spark, sf_dir, "documents", "doc_id", "text")
            .groupBy("doc_id").agg(F.min("text").alias("text")))
    return (rows.join(docs, F.col("_doc") == F.col("doc_id"), "left")
            .withColumn("description", F.coalesce(F.col("text"), F.lit(""))).drop("_doc", "doc_id", "text"))


def complaints(spark: SparkSession, sf_dir: str, as_of: datetime = AS_OF,
               dists: DataFrame | None = None) -> DataFrame:
    rows = with_description(spark, sf_dir, brief_complaints(spark, sf_dir, as_of, dists))
    return rows.select(*[f.name for f in SCHEMAS["complaints"]])


def _line_status() -> Column:
    return _pick((F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey")) % 6, LINE_STATUSES)


def line_events(spark: SparkSession, sf_dir: str, n_rows: int = 0) -> DataFrame:
    """Every lineitem row as a status event of its order (the update stream); ``n_rows`` of them, where known."""
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
               "l_extendedprice", "l_returnflag", "l_linestatus")
    o = _dealt(_read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), n_rows, "o_orderkey")
    ts = plus_seconds(plus_days("o_orderdate", F.col("l_linenumber")), F.col("l_partkey") % 86400)
    return (li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
              .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                      "l_returnflag", "l_linestatus", ts.alias("ts"), _line_status().alias("line_status")))


LINE_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _line_note() -> Column:
    return F.when(F.col("l_linestatus") == "F", F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")))


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


def timeline(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = _as_they_are) -> DataFrame:
    """``keep`` may store the lines that the numbering reads several times."""
    n = _rows_of(spark, sf_dir, *MADE_OF["timeline"])
    ev = keep(line_events(spark, sf_dir, n).filter(
        (F.col("line_status") != "closed") & (F.col("l_partkey") % 97 != 0)))
    ranked = global_rank(ev, bucket_of("ts"), LINE_ORDER, "id", n_rows=n)
    return ranked.select(
        "id", F.col("l_orderkey").alias("complaint_id"), F.col("line_status").alias("status"),
        _line_note().alias("note"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("int"))
         .otherwise(F.col("l_suppkey").cast("int")).alias("updated_by"),
        F.col("ts").alias("created_at"))


def status_updates(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = _as_they_are) -> DataFrame:
    """Status-change requests: (update_id, complaint_id, status, note, officer_id, ts); ``keep`` as in ``timeline``."""
    n = _rows_of(spark, sf_dir, *MADE_OF["timeline"])
    lines = keep(line_events(spark, sf_dir, n).drop("line_status", "l_returnflag"))  # the status is not moved with the line
    ranked = global_rank(lines, bucket_of("ts"), LINE_ORDER, "update_id", n_rows=n)
    return ranked.select(
        "update_id",
        (F.col("l_orderkey") + F.when(F.col("l_partkey") % 97 == 0, F.lit(UNKNOWN_ID_OFFSET))
         .otherwise(F.lit(0))).alias("complaint_id"),
        _line_status().alias("status"), _line_note().alias("note"),
        (F.col("l_suppkey") + F.when(F.col("l_partkey") % 89 == 0, F.lit(UNKNOWN_OFFICER_OFFSET)).otherwise(F.lit(0)))
        .cast("int").alias("officer_id"), "ts")


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    n = _read(spark, sf_dir, "orders", "o_orderkey").count()
    return p.select(
        F.col("page_id").alias("id"), (F.col("page_id") % max(n // FILE_SHARE, 1)).alias("complaint_id"),
        F.col("url").alias("file_url"),
        F.when(F.col("page_id") % 3 == 0, "image").otherwise("pdf").alias("file_type"),
        F.round(F.length("html") / F.lit(1024.0)).cast("int").alias("file_size_kb"),
        plus_seconds(ts_lit(UPLOAD_BASE), F.col("page_id") * 60).alias("uploaded_at"))


def notifications(spark: SparkSession, sf_dir: str, comps: DataFrame | None = None) -> DataFrame:
    """Outbox rows of past filings: one per complaint, with the caller's id even for anonymous
    filings (the leak the audit finds).  Every NO_MESSAGES-th caller has opted out of messages."""
    o = _dealt(_read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").filter(F.col("o_custkey") % NO_MESSAGES != 0),
               _rows_of(spark, sf_dir, *MADE_OF["notifications"]), "o_orderkey")
    nums = (comps if comps is not None else complaints(spark, sf_dir)).select(
        F.col("id").alias("_cid"), "complaint_no", "created_at")
    return (o.join(nums, o["o_orderkey"] == nums["_cid"], "inner")
             .select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("complaint_id"),
                     F.col("o_custkey").alias("citizen_id"), F.lit("sms").alias("channel"),
                     F.concat(F.lit("Complaint registered: "), F.col("complaint_no")).alias("message"),
                     F.lit("sent").alias("status"), F.col("created_at").alias("sent_at")))


def load_testdata_model(spark: SparkSession, sf_dir: str, as_of: datetime = AS_OF) -> Model:
    dists = districts(spark, sf_dir)
    brief = brief_complaints(spark, sf_dir, as_of, dists)
    comps = with_description(spark, sf_dir, brief).select(*[f.name for f in SCHEMAS["complaints"]])
    return Model(districts=dists, mandals=mandals(spark, sf_dir), departments=departments(spark),
                 citizens=citizens(spark, sf_dir), officers=officers(spark, sf_dir), complaints=comps,
                 attachments=attachments(spark, sf_dir), timeline=timeline(spark, sf_dir),
                 notifications=notifications(spark, sf_dir, comps), upvotes=upvotes(spark, sf_dir),
                 as_of=as_of, extra={"described": (brief, lambda rows: with_description(spark, sf_dir, rows)),
                                     "described_by": "_doc", "made": {"timeline": partial(timeline, spark, sf_dir)},
                                     "rows": {name: partial(_rows_of, spark, sf_dir, *made)
                                              for name, made in MADE_OF.items()}})


# --------------------------------------------------------------------------
# Request streams for the jobs (batch inputs; the streams read the same rows)
# --------------------------------------------------------------------------

def filing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    key = F.col("o_orderkey")
    district = (F.col("c_nationkey") % DISTRICT_MOD).cast("int")
    # merged: customers grow with the orders, and by the size of their files they would be broadcast
    return (o.join(c.hint("merge"), o["o_custkey"] == c["c_custkey"], "inner").select(
        key.alias("request_id"),
        F.when(key % 83 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("caller_id"),
        F.when(key % 67 == 0, F.lit(None).cast("int"))
         .otherwise(((key + F.col("o_custkey")) % 9 + 1).cast("int")).alias("department_id"),
        F.when(key % 59 == 0, F.lit(None).cast("int")).when(key % 61 == 0, F.lit(99))
         .otherwise(district).alias("district_id"),
        F.when(key % 5 == 0, F.lit(None).cast("int")).when(key % 79 == 0, F.lit(99_999))
         .otherwise(district * 5 + segment_index(F.col("c_mktsegment"))).cast("int").alias("mandal_id"),
        F.when(key % 101 == 0, F.repeat(F.lit("v"), 201)).otherwise(F.lit(None).cast("string")).alias("village"),
        F.when(key % 53 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("Case "), key.cast("string"),
                             F.when(key % 73 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.lit("")))).alias("title"),
        F.concat(F.lit("Report "), key.cast("string")).alias("description"),
        F.when(key % 71 == 0, "purple")
         .when(F.col("o_orderpriority") == "1-URGENT", "emergency")
         .when(F.col("o_orderpriority") == "2-HIGH", "urgent")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "normal")
         .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
         .otherwise(F.lit(None).cast("string")).alias("priority"),
        F.when(key % 89 == 0, "abc").when(key % 11 == 0, "16.5").alias("latitude"),
        F.when(key % 11 == 0, "").when(key % 13 == 0, "80.25").alias("longitude"),
        F.when(key % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Door "), key.cast("string"))).alias("address"),
        F.when(key % 7 == 0, "true").otherwise("false").alias("is_anonymous"),
        F.when(key % 3 == 0, F.format_string("%012d", F.col("o_custkey")))
         .when(key % 3 == 1, F.lit("")).otherwise(F.lit(None).cast("string")).alias("aadhaar"),
        F.when(key % 97 == 0, F.lit("a source of 21 letter"))
         .when(key % 4 == 0, F.lit("mobile")).otherwise(F.lit(None).cast("string")).alias("source"),
        F.col("o_orderdate").alias("ts")))


def upload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files sent with filings: 4 per request, a 5th/6th when page_id % 9 = 0 repeats into the next."""
    p = _read(spark, sf_dir, "pages", "page_id", "html")
    req = F.explode(F.array(F.floor(F.col("page_id") / 4),
                            F.when(F.col("page_id") % 9 == 0, F.floor(F.col("page_id") / 4) + 1)))
    size = F.length("html").cast("long") * F.when(F.col("page_id") % 23 == 0, F.lit(1000)).otherwise(F.lit(1))
    return (p.select(F.col("page_id").alias("file_id"), req.alias("request_id"),
                     F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("text/html").alias("mimetype"),
                     size.alias("size_bytes"))
             .filter(F.col("request_id").isNotNull())
             .withColumn("request_id", F.col("request_id").cast("long")))


def registration_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("request_id"),
        F.when(k % 31 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 5 == 0, F.format_string("9%09d", k))
         .otherwise(F.format_string("7%09d", F.floor(k / 2))).alias("phone"),
        F.when(k % 47 == 0, F.concat(F.repeat(F.lit("c"), 200), F.lit("@mail.example.org")))
         .when(k % 3 == 0, F.format_string("c%d@mail.example.org", k)).alias("email"),
        F.when(k % 41 == 0, F.lit(99)).otherwise(F.col("c_nationkey") % DISTRICT_MOD).cast("int").alias("district_id"),
        F.when(k % 43 == 0, F.lit(99999)).when(k % 2 == 0, F.col("c_nationkey") * 5 + k % 5).cast("int")
         .alias("mandal_id"),
        F.when(k % 53 == 0, F.repeat(F.lit("v"), 201)).when(k % 7 == 0, F.format_string("Village %d", k % 100))
         .alias("village"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("en"))
         .otherwise(F.lit("te")).alias("lang_pref"),
        plus_seconds(ts_lit(REGISTRATION_BASE), (k * 37) % 1000).alias("ts"))


def _addresses(key: Column, caller: Column) -> list[Column]:
    """Raw addresses of a request: the caller behind two proxies, behind a blank entry, or directly; some send none."""
    blank = (key % 3 != 0) & (key % 101 == 0)
    return [F.when(key % 3 == 0, F.concat(F.lit(" "), caller, F.lit(" , 10.0.0."), (key % 250).cast("string")))
            .when(key % 3 == 1, F.lit(" ,10.0.0.1")).alias("forwarded_for"),
            F.when(key % 3 == 0, F.lit("10.9.9.9")).when(blank, F.lit("")).otherwise(caller).alias("remote_addr")]


def vote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upvote requests: click/view events from the cutoff on, by complaint number."""
    e = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    nums = complaints(spark, sf_dir).select(F.col("id").alias("_cid"), "complaint_no")
    v = (e.filter(F.col("event_type").isin("click", "view") & (F.col("ts") >= ts_lit(VOTE_CUTOFF)))
          .withColumn("_cid", _vote_target(spark, sf_dir)))
    return (v.join(nums, "_cid", "left").select(
        F.col("event_id").alias("vote_id"),
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("AP-0000-D99-"), F.col("event_id").cast("string")))
         .otherwise(F.col("complaint_no")).alias("complaint_no"),
        *_addresses(F.col("event_id"), F.concat(F.lit("v"), F.col("user_id").cast("string"))), "ts"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return (e.filter(F.col("event_type") == "purchase")
             .select(F.when(F.col("event_id") % 2 == 0, "citizen").otherwise("officer").alias("actor_type"),
                     F.col("user_id").alias("actor_id"), "ts"))


ROUTES = [("signup", "otp_send"), ("error", "otp_verify"), ("purchase", "file_complaint"),
          ("click", "upvote"), ("view", "browse")]


def client_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    route = None
    for et, r in ROUTES:
        route = F.when(F.col("event_type") == et, r) if route is None else route.when(F.col("event_type") == et, r)
    return e.select(F.col("event_id").alias("request_id"),
                    *_addresses(F.col("event_id"), F.concat(F.lit("c"), F.col("user_id").cast("string"))),
                    route.alias("route"), "ts")


def code_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-05 input: sends (signup) and attempts (click/error) per phone."""
    e = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    phone = F.when(F.col("user_id") % 50 == 0, F.format_string("9%08d", F.col("user_id"))) \
             .otherwise(F.format_string("9%09d", F.col("user_id")))
    return (e.filter(F.col("event_type").isin("signup", "click", "error"))
             .select(F.col("event_id").alias("event_id"), phone.alias("phone"),
                     F.when(F.col("event_type") == "signup", "send").otherwise("attempt").alias("kind"),
                     F.when((F.col("event_type") == "signup") | (F.col("event_id") % 3 != 0), F.lit(TEST_CODE))
                      .otherwise(F.lit("000000")).alias("code"),
                     "ts"))
