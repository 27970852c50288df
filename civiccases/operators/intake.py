"""J-01..J-11: set-based intake of complaint filings and citizen registrations.

A batch of requests goes through one plan: every check becomes a reason
column (NULL = passed), the first failing check wins, and accepted and
rejected rows are two filters of the same plan.  Nothing is written in place;
the outputs are the new rows each table would receive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.functions.expr import (blank_to_null, falsy_default, identity_hash, is_blank, plus_days)
from civiccases.plans.ranking import bucket_of, global_rank
from civiccases.sources.model import (COMPLAINT_NO_DIGITS, COMPLAINT_NO_PREFIX, DEFAULT_SLA_DAYS, FILING_NOTE,
                                      MAX_FILE_BYTES, MAX_FILES, OUTBOX_FILING_TEMPLATE, PRIORITIES,
                                      PUBLIC_DEPARTMENTS, Model)

REQUIRED_FIELDS_REASON = "Department, district, title and description are required"
INVALID_DISTRICT = "Invalid district"
INVALID_DEPARTMENT = "Invalid department"
TOO_MANY_FILES = "Too many files"
FILE_TOO_LARGE = "File too large"
INVALID_PRIORITY = "Invalid priority"
INVALID_COORDINATES = "Invalid coordinates"
TITLE_TOO_LONG = "Title too long"
VILLAGE_TOO_LONG = "Village too long"
SOURCE_TOO_LONG = "Source too long"
INVALID_MANDAL = "Invalid mandal"
UNKNOWN_CALLER = "Unknown caller"
# fixed values: column types and lengths of the complaints table
LATITUDE, LONGITUDE = "decimal(10,8)", "decimal(11,8)"
MAX_TITLE, MAX_VILLAGE, MAX_SOURCE = 300, 200, 20


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first failing check, NULL when all pass."""
    expr = None
    for failed, reason in checks:
        expr = F.when(failed, F.lit(reason)) if expr is None else expr.when(failed, F.lit(reason))
    return expr.otherwise(F.lit(None).cast("string"))


# ------------------------------------------------------------------ J-01

def intake_validate(requests: DataFrame) -> DataFrame:
    """Required fields in the JS sense: NULL or '' fails (ids: NULL or 0)."""
    missing = (F.col("department_id").isNull() | (F.col("department_id") == 0) |
               F.col("district_id").isNull() | (F.col("district_id") == 0) |
               is_blank("title") | is_blank("description"))
    return requests.withColumn("reason", first_reason((missing, REQUIRED_FIELDS_REASON)))


# ------------------------------------------------------------------ J-02

def resolve_reference(m: Model, requests: DataFrame) -> DataFrame:
    """District code (unknown -> 'Invalid district') and SLA days (``sla_days || 7``).

    An unknown department gets 7 days in the reference and then fails the
    foreign key on insert; here it is a reject reason.
    """
    d = m.districts.select(F.col("id").alias("_did"), F.col("code").alias("district_code"))
    dep = m.departments.select(F.col("id").alias("_depid"), F.col("sla_days").alias("_sla"))
    out = (requests.join(d, F.col("district_id") == F.col("_did"), "left")
                   .join(dep, F.col("department_id") == F.col("_depid"), "left"))
    return (out.withColumn("sla_days", falsy_default("_sla", DEFAULT_SLA_DAYS, 0))
               .withColumn("ref_reason", first_reason((F.col("_did").isNull(), INVALID_DISTRICT),
                                                      (F.col("_depid").isNull(), INVALID_DEPARTMENT)))
               .drop("_did", "_depid", "_sla"))


# ------------------------------------------------------------------ J-03 / J-04

def assign_complaint_no(accepted: DataFrame, start: int | Column = 1, ts: str = "ts",
                        key: str = "request_id") -> DataFrame:
    """Global dense sequence in (ts, key) order from ``start``; numbers widen past 99,999 (D6)."""
    ranked = global_rank(accepted, bucket_of(ts, "hour"), [ts, key], "seq", start)
    return ranked.withColumn("complaint_no", F.concat_ws(
        "-", F.lit(COMPLAINT_NO_PREFIX), F.year(ts).cast("string"), F.col("district_code"),
        F.format_string(f"%0{COMPLAINT_NO_DIGITS}d", F.col("seq"))))


def sla_deadline(created: Column | str, sla_days: Column | str) -> Column:
    """created + sla_days x 86,400 s (elapsed time, not calendar days)."""
    return plus_days(created, F.col(sla_days) if isinstance(sla_days, str) else sla_days)


# ------------------------------------------------------------------ J-05..J-07

def hash_identity(accepted: DataFrame, salt: str = "") -> DataFrame:
    """Citizen updates: latest non-blank identity per caller (by ts, request_id), hashed."""
    with_id = accepted.filter(~is_blank("aadhaar") & F.col("caller_id").isNotNull())
    latest = with_id.groupBy("caller_id").agg(
        F.max_by("aadhaar", F.struct("ts", "request_id")).alias("_aadhaar"))
    return latest.select(F.col("caller_id").alias("citizen_id"), identity_hash("_aadhaar", salt).alias("aadhaar_hash"))


def apply_identity(m: Model, updates: DataFrame) -> DataFrame:
    """The next citizens snapshot: each updated citizen's ``aadhaar_hash`` replaced (J-05).

    ``updates`` holds at most one row per citizen (``hash_identity`` keeps the
    latest), so the left join cannot multiply citizens.
    """
    u = updates.select(F.col("citizen_id").alias("_cid"), F.col("aadhaar_hash").alias("_hash"))
    return (m.citizens.join(u, F.col("id") == F.col("_cid"), "left")
                      .withColumn("aadhaar_hash", F.when(F.col("_cid").isNotNull(), F.col("_hash"))
                                  .otherwise(F.col("aadhaar_hash")))
                      .drop("_cid", "_hash"))


def anonymise(requests: DataFrame) -> DataFrame:
    anonymous = is_anonymous_request()
    return (requests.withColumn("citizen_id", F.when(anonymous, F.lit(None).cast("long"))
                                .otherwise(F.col("caller_id")))
                    .withColumn("is_anonymous_flag", anonymous))


def defaults_and_visibility(requests: DataFrame) -> DataFrame:
    return (requests.withColumn("priority", falsy_default("priority", "normal"))
                    .withColumn("source", falsy_default("source", "web"))
                    .withColumn("latitude", blank_to_null("latitude").try_cast(LATITUDE))
                    .withColumn("longitude", blank_to_null("longitude").try_cast(LONGITUDE))
                    .withColumn("address", blank_to_null("address"))
                    .withColumn("is_public", F.coalesce(F.col("department_id").isin(*PUBLIC_DEPARTMENTS),
                                                        F.lit(False))))


# ------------------------------------------------------------------ J-08

def upload_verdicts(uploads: DataFrame) -> DataFrame:
    """Per request: file count and the reason its upload is refused (NULL = fine).

    A partial aggregate (count, max), so a request with very many files is
    merged across map tasks, never collected.
    """
    per_req = uploads.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_files"),
                                                F.max("size_bytes").alias("_max_bytes"))
    return per_req.select("request_id", "n_files", first_reason(
        (F.col("n_files") > MAX_FILES, TOO_MANY_FILES),
        (F.col("_max_bytes") > MAX_FILE_BYTES, FILE_TOO_LARGE)).alias("upload_reason"))


def attachment_classify(uploads: DataFrame) -> DataFrame:
    """Per file: type and KB, with its request's verdict (one bad file rejects the request)."""
    files = uploads.select(
        "request_id", "file_id",
        F.when(F.coalesce(F.col("mimetype").startswith("image"), F.lit(False)), "image")
         .otherwise("pdf").alias("file_type"),
        F.round(F.col("size_bytes") / F.lit(1024.0)).cast("int").alias("file_size_kb"))
    return files.join(upload_verdicts(uploads), "request_id", "inner")


# ------------------------------------------------------------------ J-09..J-10

@dataclass
class FilingResult:
    complaints: DataFrame      # new complaint rows
    rejects: DataFrame         # request_id, reason
    timeline: DataFrame        # initial rows (J-09)
    attachments: DataFrame     # accepted files
    outbox: DataFrame          # notification rows
    citizen_updates: DataFrame  # (citizen_id, aadhaar_hash)
    events: DataFrame          # message events: (event, complaint_id, complaint_no, citizen_id = caller)


def initial_timeline(new_complaints: DataFrame) -> DataFrame:
    return new_complaints.select(F.col("id").alias("complaint_id"), F.lit("submitted").alias("status"),
                                 F.lit(FILING_NOTE).alias("note"), F.lit(None).cast("int").alias("updated_by"),
                                 F.col("created_at"))


def is_anonymous_request() -> Column:
    return F.coalesce(F.col("is_anonymous") == F.lit("true"), F.lit(False))


def constraint_reasons(m: Model, requests: DataFrame) -> DataFrame:
    """What the complaints table itself refuses: enum, number format, lengths, mandal, filer.

    ``caller_unknown`` is kept: an anonymous filing stores no citizen, so an
    unknown caller does not reject it, but no notification can name them.
    Unknown callers are found among the distinct callers, so the requests
    join a set that AQE broadcasts once it has measured it small.  The citizens
    are merged, never broadcast: an estimate from the files takes the ids of
    millions for small, and every such join would gather them in the driver.
    """
    mandals = m.mandals.select(F.col("id").alias("_mid")).distinct()
    unknown = (requests.select(F.col("caller_id").alias("_caller")).where("_caller is not null").distinct()
               .join(m.citizens.select(F.col("id").alias("_cit")).hint("merge"), F.col("_caller") == F.col("_cit"), "left_anti"))
    out = (requests.join(mandals, F.col("mandal_id") == F.col("_mid"), "left")
                   .join(unknown, F.col("caller_id") == F.col("_caller"), "left")
                   .withColumn("caller_unknown", F.col("_caller").isNotNull()))

    def malformed(name: str, kind: str) -> Column:
        text = blank_to_null(name)
        return text.isNotNull() & text.try_cast(kind).isNull()

    return (out.withColumn("constraint_reason", first_reason(
        (~falsy_default("priority", "normal").isin(*PRIORITIES), INVALID_PRIORITY),
        (malformed("latitude", LATITUDE) | malformed("longitude", LONGITUDE), INVALID_COORDINATES),
        (F.char_length("title") > MAX_TITLE, TITLE_TOO_LONG),
        (F.char_length("village") > MAX_VILLAGE, VILLAGE_TOO_LONG),
        (F.char_length("source") > MAX_SOURCE, SOURCE_TOO_LONG),
        (F.col("mandal_id").isNotNull() & F.col("_mid").isNull(), INVALID_MANDAL),
        (F.col("caller_unknown") & ~is_anonymous_request(), UNKNOWN_CALLER))).drop("_mid", "_caller"))


def _checked(m: Model, requests: DataFrame, uploads: DataFrame | None) -> DataFrame:
    req = intake_validate(requests)
    if uploads is not None:
        verdicts = upload_verdicts(uploads).filter(F.col("upload_reason").isNotNull())
        req = req.join(verdicts, "request_id", "left")
    else:
        req = req.withColumn("upload_reason", F.lit(None).cast("string"))
    req = constraint_reasons(m, resolve_reference(m, req))
    # multer rejects uploads before the handler runs, so upload reasons come first; the table's own checks come last
    return req.withColumn("reject_reason", F.coalesce("upload_reason", "reason", "ref_reason", "constraint_reason"))


def file_complaints(m: Model, requests: DataFrame, uploads: DataFrame | None = None, start: int = 1,
                    salt: str = "", keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> FilingResult:
    """J-10: all-or-nothing per request; accepted rows get numbers from ``start``.

    ``keep`` may hold the checked and the numbered rows, which several outputs share (``DataFrame.persist``).
    """
    checked = keep(_checked(m, requests, uploads))
    accepted = checked.filter(F.col("reject_reason").isNull())
    rejects = checked.filter(F.col("reject_reason").isNotNull()).select(
        "request_id", F.col("reject_reason").alias("reason"))
    rows = keep(defaults_and_visibility(anonymise(assign_complaint_no(accepted, start))))
    new = rows.select(
        F.col("request_id").alias("id"), "complaint_no", "citizen_id", "department_id", "district_id",
        "mandal_id", "village", "title", "description", "priority", "latitude", "longitude", "address",
        F.lit("submitted").alias("status"), F.lit(None).cast("int").alias("assigned_to"),
        sla_deadline("ts", "sla_days").alias("sla_deadline"),
        F.lit(False).alias("is_overdue"), F.col("is_anonymous_flag").alias("is_anonymous"), "source",
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        "is_public", F.lit(None).cast("int").alias("upvote_count"))
    if uploads is not None:
        files = attachment_classify(uploads).join(
            accepted.select("request_id", F.col("ts").alias("uploaded_at")), "request_id")
        atts = files.select(F.col("file_id").alias("id"), F.col("request_id").alias("complaint_id"),
                            F.concat(F.lit("upload://"), F.col("request_id").cast("string"), F.lit("/"),
                                     F.col("file_id").cast("string")).alias("file_url"),
                            "file_type", "file_size_kb", "uploaded_at")
    else:
        atts = m.attachments.limit(0)
    outbox = rows.where(~F.col("caller_unknown")).select(F.col("request_id").alias("complaint_id"), F.col("caller_id").alias("citizen_id"),
                         F.lit("sms").alias("channel"),
                         F.format_string(OUTBOX_FILING_TEMPLATE, F.col("complaint_no")).alias("message"),
                         F.lit("sent").alias("status"), F.col("ts").alias("sent_at"))
    # the filing SMS goes to the caller, also for anonymous filings
    events = rows.select(F.lit("filed").alias("event"), F.col("request_id").alias("complaint_id"), "complaint_no",
                         F.col("caller_id").alias("citizen_id"))
    return FilingResult(complaints=new, rejects=rejects, timeline=initial_timeline(new), attachments=atts,
                        outbox=outbox, citizen_updates=hash_identity(accepted, salt), events=events)


# ------------------------------------------------------------------ J-11

PHONE_TAKEN = "Phone already registered. Please login."
NAME_PHONE_REQUIRED = "Name and phone are required"
NAME_TOO_LONG = "Name too long"
PHONE_TOO_LONG = "Phone too long"
EMAIL_TOO_LONG = "Email too long"
LANGUAGE_TOO_LONG = "Language too long"
MAX_NAME, MAX_PHONE, MAX_EMAIL, MAX_LANGUAGE = 200, 15, 200, 5


def register_citizens(m: Model, requests: DataFrame) -> DataFrame:
    """Per request: accepted flag, reason, and the citizen row it creates.

    Name and phone come first, then a taken phone (stored, or registered by an
    earlier accepted request of the batch), then what the citizens table itself
    refuses: lengths, an unknown district or mandal.  A refused request does
    not take its phone.  The first acceptable request of a phone by (ts,
    request_id) is found with a partial aggregate (min of the struct) rather
    than a window, so a hot phone is merged across map tasks.
    """
    districts = m.districts.select(F.col("id").alias("_did")).distinct()
    mandals = m.mandals.select(F.col("id").alias("_mid")).distinct()
    stored = m.citizens.select(F.col("phone").alias("_phone")).distinct()
    checked = (requests.join(stored, F.col("phone") == F.col("_phone"), "left")
               .join(districts, F.col("district_id") == F.col("_did"), "left")
               .join(mandals, F.col("mandal_id") == F.col("_mid"), "left"))
    checked = checked.withColumns({
        "_incomplete": is_blank("name") | is_blank("phone"),
        "_refused": first_reason(
            (F.char_length("name") > MAX_NAME, NAME_TOO_LONG),
            (F.char_length("phone") > MAX_PHONE, PHONE_TOO_LONG),
            (F.char_length("email") > MAX_EMAIL, EMAIL_TOO_LONG),
            (F.char_length("village") > MAX_VILLAGE, VILLAGE_TOO_LONG),
            (F.char_length("lang_pref") > MAX_LANGUAGE, LANGUAGE_TOO_LONG),
            (F.col("district_id").isNotNull() & F.col("_did").isNull(), INVALID_DISTRICT),
            (F.col("mandal_id").isNotNull() & F.col("_mid").isNull(), INVALID_MANDAL))})
    firsts = (checked.where(~F.col("_incomplete") & F.col("_phone").isNull() & F.col("_refused").isNull())
              .groupBy(F.col("phone").alias("_p")).agg(F.min(F.struct("ts", "request_id")).alias("_first")))
    out = checked.join(firsts, F.col("phone") == F.col("_p"), "left")
    reason = (F.when(F.col("_incomplete"), F.lit(NAME_PHONE_REQUIRED))
              .when(F.col("_phone").isNotNull() | (F.col("_first") < F.struct("ts", "request_id")), F.lit(PHONE_TAKEN))
              .otherwise(F.col("_refused")))
    return out.select("request_id", "name", "phone", "email", falsy_default("lang_pref", "te").alias("lang_pref"),
                      "district_id", "mandal_id", "village", reason.isNull().alias("accepted"),
                      reason.alias("reason"), "ts")
