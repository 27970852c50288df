"""Q-01..Q-15: lookup reports, re-aimed as batch reports over all keys.

A per-request lookup (one complaint number, one citizen) becomes either the
report for every key, or the report for a given key set passed as a
DataFrame and applied with ``left_semi`` (a broadcast semi join when the key
set is small, a shuffle one when it is not - AQE decides from its size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.functions.expr import with_caller
from civiccases.operators.common import live_overdue, queue_keys, queue_order, with_names
from civiccases.plans.paging import Key, page
from civiccases.sources.model import PAGE_SIZE, RECENT_K, TOP_ISSUES_K, Model


#: keys, below any officer's id, that rows without an officer are dealt to
UNASSIGNED_KEYS = 4096


def _complaints(m: Model, numbers: DataFrame | None = None) -> DataFrame:
    c = m.complaints
    if numbers is not None:
        c = c.join(numbers.select(F.col(numbers.columns[0]).alias("_no")),
                   F.col("complaint_no") == F.col("_no"), "left_semi")
    return c


def attach_rows(small: DataFrame, big: DataFrame, small_key: str, big_key: str,
                cols: list[Column]) -> DataFrame:
    """LEFT JOIN a bounded row set (a page, a top-k) to a large table.

    A left outer join can only broadcast its right side, so joining 20 rows
    to all citizens would shuffle the citizens table.  Instead the large
    side is first reduced by a broadcast semi join on the page's keys (a map
    -side filter of one scan), and the join runs on the survivors.
    """
    keys = F.broadcast(small.select(F.col(small_key).alias("_k")).filter(F.col("_k").isNotNull()).distinct())
    hit = big.join(keys, big[big_key] == F.col("_k"), "left_semi").select(F.col(big_key).alias("_bk"), *cols)
    return small.join(hit, F.col(small_key) == F.col("_bk"), "left").drop("_bk")


def fixed_page(rows: DataFrame, *keys: str) -> tuple[DataFrame, list[list]]:
    """(a page's rows as a literal table, the values of each key): the page is read once, at most the page size."""
    table = rows.toArrow()
    values = [[v for v in table.column(key).to_pylist() if v is not None] for key in keys]
    return rows.sparkSession.createDataFrame(table, rows.schema), values


def attach_to_page(rows: DataFrame, big: DataFrame, key: str, values: list, cols: list[Column]) -> DataFrame:
    """LEFT JOIN a literal page to a large table by ``id``; the page's keys are literals that reach the table's scan."""
    hit = big.where(F.col("id").isin(values)).select(F.col("id").alias("_bk"), *cols)
    return rows.join(F.broadcast(hit), F.col(key) == F.col("_bk"), "left").drop("_bk")


# ------------------------------------------------------------------ Q-01..Q-03

def districts_list(m: Model) -> DataFrame:
    return m.districts.select("id", "name", "name_te", "code").orderBy("name", "id")


def mandals_by_district(m: Model, district_id: int | None = None) -> DataFrame:
    df = m.mandals if district_id is None else m.mandals.filter(F.col("district_id") == district_id)
    return df.select("district_id", "id", "name", "name_te").orderBy("district_id", "name", "id")


def active_departments(m: Model) -> DataFrame:
    """Active departments by name, with the number of active officers serving each.

    The staff count is a partial aggregate over the officers table (one row
    per department and map task), joined to the bounded department list.
    """
    staff = (m.officers.filter(F.col("is_active")).groupBy(F.col("department_id").alias("_dep"))
             .agg(F.count(F.lit(1)).alias("_n")))
    deps = m.departments.filter(F.col("is_active")).select("id", "name", "name_te", "code", "sla_days")
    return (deps.join(staff, F.col("id") == F.col("_dep"), "left")
                .select("id", "name", "name_te", "code", "sla_days",
                        F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("active_officers"))
                .orderBy("name", "id"))


def seed_usage(m: Model, seed: DataFrame) -> DataFrame:
    """SRC-02 check against the data: every seed department with the complaints filed to it."""
    per = m.complaints.groupBy(F.col("department_id").alias("_dep")).agg(F.count(F.lit(1)).alias("_n"))
    return (seed.join(per, F.col("id") == F.col("_dep"), "left")
             .select(*seed.columns, F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_complaints")))


# ------------------------------------------------------------------ Q-04 / Q-05

def track_report(m: Model, numbers: DataFrame | None = None) -> DataFrame:
    c = _complaints(m, numbers).withColumn("is_overdue", live_overdue(m))
    c = with_names(c, m, mandal=True)
    return c.select("complaint_no", "title", "status", "priority", "created_at", "sla_deadline",
                    "is_overdue", "district", "department", "mandal", "village")


def timeline_history(m: Model, numbers: DataFrame | None = None) -> DataFrame:
    """Timeline rows per complaint number, oldest first; officer name by left join."""
    c = _complaints(m, numbers).select(F.col("id").alias("_cid"), "complaint_no")
    t = m.timeline.join(c, F.col("complaint_id") == F.col("_cid"), "inner")
    officers = m.officers.select(F.col("id").alias("_oid"), F.col("name").alias("updated_by_name"))
    # rows without an officer are most of the table; as one NULL key they would be one task, so they are dealt by id
    nobody = -1 - F.pmod(F.col("id"), F.lit(UNASSIGNED_KEYS))
    t = t.join(officers, F.coalesce(F.col("updated_by").cast("long"), nobody) == F.col("_oid"), "left")
    return (t.select("complaint_no", F.col("id").alias("timeline_id"), "status", "note", "created_at",
                     F.col("updated_by_name").alias("updated_by"))
             .orderBy("complaint_no", "created_at", "timeline_id"))


# ------------------------------------------------------------------ Q-06

def citizen_complaints(m: Model, citizen_ids: DataFrame | None = None) -> DataFrame:
    c = m.complaints.filter(F.col("citizen_id").isNotNull())
    if citizen_ids is not None:
        c = c.join(citizen_ids.select(F.col(citizen_ids.columns[0]).alias("_cit")),
                   F.col("citizen_id") == F.col("_cit"), "left_semi")
    c = with_names(c.withColumn("is_overdue", live_overdue(m)), m)
    return (c.select("citizen_id", "complaint_no", "title", "status", "priority", "created_at", "is_overdue",
                     "district", "department", F.col("id").alias("complaint_id"))
             .orderBy(F.col("citizen_id"), F.col("created_at").desc_nulls_first(), F.col("complaint_id")))


# ------------------------------------------------------------------ Q-07

def _queue_rows(m: Model, role: str = "admin", dept: int | None = None, status: str | None = None,
                priority: str | None = None, district_id: int | None = None) -> DataFrame:
    cond = F.lit(True)
    if role == "officer":
        cond = cond & (F.col("department_id") == F.lit(dept))
    if status:
        cond = cond & (F.col("status") == F.lit(status))
    if priority:
        cond = cond & (F.col("priority") == F.lit(priority))
    if district_id is not None:
        cond = cond & (F.col("district_id") == F.lit(district_id))
    c = m.complaints.filter(cond).withColumn("is_overdue", live_overdue(m))
    return with_names(c, m)


def _queue_people(m: Model, rows: DataFrame) -> DataFrame:
    rows = attach_rows(rows, m.citizens, "citizen_id", "id",
                       [F.col("name").alias("citizen_name"), F.col("phone").alias("citizen_phone")])
    rows = attach_rows(rows, m.officers, "assigned_to", "id", [F.col("name").alias("assigned_to_name")])
    return rows


QUEUE_STORED = ["id", "complaint_no", "title", "status", "priority", "created_at", "sla_deadline", "is_overdue",
                "district", "department"]
QUEUE_COLUMNS = [*QUEUE_STORED, "citizen_name", "citizen_phone"]


def officer_queue(m: Model, role: str = "officer", dept: int | None = None, status: str | None = None,
                  priority: str | None = None, district_id: int | None = None, page_no: int = 1,
                  page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of the work queue; the page is cut, and read, before the citizen/officer joins.

    Only the columns of the queue are read and sorted: not the descriptions, which are most of a complaint's bytes.
    """
    rows = _queue_rows(m, role, dept, status, priority, district_id).select(*QUEUE_STORED, "citizen_id", "assigned_to")
    rows = page(rows, queue_keys(), page_no, page_size)
    rows, (callers, officers) = fixed_page(rows, "citizen_id", "assigned_to")
    rows = attach_to_page(rows, m.citizens, "citizen_id", callers,
                          [F.col("name").alias("citizen_name"), F.col("phone").alias("citizen_phone")])
    rows = attach_to_page(rows, m.officers, "assigned_to", officers, [F.col("name").alias("assigned_to_name")])
    return rows.select(*QUEUE_COLUMNS, F.col("assigned_to_name").alias("assigned_to")).orderBy(*queue_order())


def officer_queue_all(m: Model, page_size: int = PAGE_SIZE) -> DataFrame:
    """Page 1 of the queue of every department at once.

    A literal ``row_number() <= 20`` over (department) lets Spark insert a
    WindowGroupLimit below the shuffle, so each map task ships at most 20
    rows per department.
    """
    w = Window.partitionBy("department_id").orderBy(*queue_order())
    ranked = (_queue_rows(m).withColumn("queue_pos", F.row_number().over(w))
              .filter(F.col("queue_pos") <= page_size)
              .withColumn("queue_pos", F.col("queue_pos").cast("long")))
    out = _queue_people(m, ranked)
    return out.select("department_id", "queue_pos", *QUEUE_COLUMNS, F.col("assigned_to_name").alias("assigned_to"))


# ------------------------------------------------------------------ Q-08 / Q-09 / Q-10

def complaint_detail(m: Model, ids: DataFrame | None = None) -> DataFrame:
    c, described = m.brief()
    if ids is not None:
        c = c.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col("id") == F.col("_id"), "left_semi")
    c = with_names(c.withColumn("is_overdue", live_overdue(m)), m, mandal=True, district_code=True,
                   dept_code=True)
    cit = m.citizens.select(F.col("id").alias("_cit"), F.col("name").alias("citizen_name"),
                            F.col("phone").alias("citizen_phone"), "lang_pref")
    off = m.officers.select(F.col("id").alias("_off"), F.col("name").alias("assigned_to_name"))
    c = (c.join(cit, F.col("citizen_id") == F.col("_cit"), "left")
          .join(off, F.col("assigned_to") == F.col("_off"), "left"))
    return described(c).select("id", "complaint_no", "title", "description", "status", "priority", "created_at",
                               "sla_deadline", "is_overdue", "upvote_count", "latitude", "longitude", "address", "village",
                               "is_anonymous", "district", "district_code", "department", "dept_code", "mandal",
                               "citizen_name", "citizen_phone", "lang_pref", F.col("assigned_to_name").alias("assigned_to"))


def attachment_manifest(m: Model) -> DataFrame:
    return (m.attachments.select("complaint_id", F.col("id").alias("attachment_id"), "file_url", "file_type",
                                 "file_size_kb", "uploaded_at")
             .orderBy("complaint_id", "uploaded_at", "attachment_id"))


def case_file(m: Model, ids: DataFrame) -> DataFrame:
    """Nested record per requested complaint: detail + attachments[] + timeline[].

    For display of a requested set of complaints: the arrays are built per
    complaint, so this is not meant for a whole table (use
    ``case_file_summary`` or the flat reports there).
    """
    detail = complaint_detail(m, ids)
    wanted = ids.select(F.col(ids.columns[0]).alias("_id"))
    att = (m.attachments.join(wanted, F.col("complaint_id") == F.col("_id"), "left_semi")
           .groupBy("complaint_id")
           .agg(F.array_sort(F.collect_list(F.struct("uploaded_at", "id", "file_url", "file_type",
                                                     "file_size_kb"))).alias("attachments")))
    off = m.officers.select(F.col("id").alias("_oid"), F.col("name").alias("officer"))
    tl = (m.timeline.join(wanted, F.col("complaint_id") == F.col("_id"), "left_semi")
          .join(off, F.col("updated_by") == F.col("_oid"), "left")
          .groupBy("complaint_id")
          .agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "status", "note",
                                                    F.col("officer").alias("updated_by")))).alias("timeline")))
    out = (detail.join(att.withColumnRenamed("complaint_id", "_a"), F.col("id") == F.col("_a"), "left")
                 .join(tl.withColumnRenamed("complaint_id", "_t"), F.col("id") == F.col("_t"), "left"))
    empty_a = F.array().cast(att.schema["attachments"].dataType)
    empty_t = F.array().cast(tl.schema["timeline"].dataType)
    return out.select(F.struct(*[F.col(c) for c in detail.columns]).alias("complaint"),
                      F.coalesce("attachments", empty_a).alias("attachments"),
                      F.coalesce("timeline", empty_t).alias("timeline"))


def case_file_summary(m: Model) -> DataFrame:
    """Sizes and first/last entries of every complaint's case file.

    Built from partial aggregates (count, min_by, max_by), so a complaint
    with a huge history is merged across map tasks instead of collected.
    """
    att = m.attachments.groupBy("complaint_id").agg(
        F.count(F.lit(1)).alias("n_attachments"), F.sum("file_size_kb").cast("long").alias("attachment_kb"),
        F.min_by("file_url", F.struct("uploaded_at", "id")).alias("first_file_url"))
    tl = m.timeline.groupBy("complaint_id").agg(
        F.count(F.lit(1)).alias("n_timeline"),
        F.min_by("status", F.struct("created_at", "id")).alias("first_status"),
        F.max_by("status", F.struct("created_at", "id")).alias("last_status"),
        F.max("created_at").alias("last_update_at"))
    c = m.complaints.select("id", "complaint_no")
    out = (c.join(att.withColumnRenamed("complaint_id", "_a"), F.col("id") == F.col("_a"), "left")
            .join(tl.withColumnRenamed("complaint_id", "_t"), F.col("id") == F.col("_t"), "left"))
    return out.select(F.col("id").alias("complaint_id"), "complaint_no",
                      F.coalesce("n_attachments", F.lit(0)).alias("n_attachments"),
                      F.coalesce("attachment_kb", F.lit(0)).alias("attachment_kb"), "first_file_url",
                      F.coalesce("n_timeline", F.lit(0)).alias("n_timeline"), "first_status", "last_status",
                      "last_update_at")


# ------------------------------------------------------------------ Q-11..Q-13

def feed_keys() -> list[Key]:
    """Feed: votes DESC (NULL first), newest first, id."""
    return [Key(F.col("upvote_count"), descending=True, nulls_first=True),
            Key(F.col("created_at"), "time", descending=True, nulls_first=True), Key(F.col("id"))]


def public_feed(m: Model, district_id: int | None = None, department_id: int | None = None,
                page_no: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    cond = F.col("is_public") & ~F.col("status").isin("rejected")
    if district_id is not None:
        cond = cond & (F.col("district_id") == district_id)
    if department_id is not None:
        cond = cond & (F.col("department_id") == department_id)
    c = with_names(m.complaints.filter(cond), m, district_code=True, dept_code=True)
    rows = page(c, feed_keys(), page_no, page_size)
    rows = with_names(rows.withColumn("is_overdue", live_overdue(m)), m, district=False, department=False,
                      mandal=True)
    return (rows.orderBy(*[key.sort for key in feed_keys()])
                .select("complaint_no", "title", "status", "priority", "created_at", "sla_deadline",
                        "is_overdue", "upvote_count", "district", "district_code", "department", "dept_code",
                        "mandal"))


def top_rows(m: Model, df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in ``order`` of those with a known district and department."""
    d = m.districts.select(F.col("id").alias("_sd"))
    dep = m.departments.select(F.col("id").alias("_sdep"))
    df = (df.join(d, F.col("district_id") == F.col("_sd"), "left_semi")
            .join(dep, F.col("department_id") == F.col("_sdep"), "left_semi"))
    return df.orderBy(*order).limit(k)


def _top_then_names(m: Model, df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Top-k on the fact table first, then the dimension joins.

    Valid because the joins are inner over audited NOT NULL foreign keys; the
    semi joins of ``top_rows`` keep it exact if one is not.
    """
    return with_names(top_rows(m, df, order, k), m)


def recent_order() -> list[Column]:
    return [F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def top_order() -> list[Column]:
    return [F.col("upvote_count").desc(), F.col("id").asc()]


def recent_activity(m: Model, k: int = RECENT_K) -> DataFrame:
    top = _top_then_names(m, m.complaints, recent_order(), k)
    return top.orderBy(*recent_order()).select("complaint_no", "title", "status", "priority", "created_at",
                      live_overdue(m).alias("is_overdue"), "district", "department")


def top_issues(m: Model, k: int = TOP_ISSUES_K) -> DataFrame:
    c = m.complaints.filter(F.col("upvote_count") > 0)
    top = _top_then_names(m, c, top_order(), k)
    return top.orderBy(*top_order()).select("complaint_no", "title", "upvote_count", "status", "priority", "district", "department")


# ------------------------------------------------------------------ Q-14 / Q-15

def upvote_status(m: Model, pairs: DataFrame) -> DataFrame:
    """Per distinct (complaint number, voter) pair: current count and whether that voter has voted."""
    p = with_caller(pairs, "voter_ip").select("complaint_no", "voter_ip").distinct()
    c = m.complaints.select(F.col("id").alias("_cid"), "complaint_no", "upvote_count")
    found = p.join(c, "complaint_no", "inner")
    votes = m.upvotes.select(F.col("complaint_id").alias("_vc"), F.col("voter_ip").alias("_vv"),
                             F.lit(True).alias("_hit")).distinct()
    out = found.join(votes, (F.col("_cid") == F.col("_vc")) & (F.col("voter_ip") == F.col("_vv")), "left")
    return out.select("complaint_no", "voter_ip",
                      F.coalesce(F.col("upvote_count"), F.lit(0)).alias("upvote_count"),
                      F.col("_hit").isNotNull().alias("has_upvoted"))


def contact_lookup(m: Model) -> DataFrame:
    """Contact of the filer of every complaint; anonymous complaints have none (inner join)."""
    c = m.complaints.select(F.col("id").alias("complaint_id"), "complaint_no", "citizen_id") \
                    .filter(F.col("citizen_id").isNotNull())
    cit = m.citizens.select(F.col("id").alias("_cit"), "phone", "name", "lang_pref")
    return c.join(cit, F.col("citizen_id") == F.col("_cit"), "inner").drop("_cit")


def contact_by_phone(m: Model, phones: DataFrame) -> DataFrame:
    """The citizens with one of the given phone numbers (first column of ``phones``)."""
    wanted = phones.select(F.col(phones.columns[0]).alias("_phone"))
    return (m.citizens.select("id", "name", "phone", "lang_pref")
             .join(wanted, F.col("phone") == F.col("_phone"), "left_semi"))


def contact_by_id(m: Model, ids: DataFrame) -> DataFrame:
    """The citizens with one of the given ids (first column of ``ids``)."""
    wanted = ids.select(F.col(ids.columns[0]).alias("_wanted"))
    return (m.citizens.select("id", "phone", "name", "lang_pref")
             .join(wanted, F.col("id") == F.col("_wanted"), "left_semi"))
