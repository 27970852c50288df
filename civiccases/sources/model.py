"""Data model of the complaints desk: table schemas, enums, seeds and rule constants.

Every table of the model is a plain DataFrame with the schema below.  Keys
that are UUIDs in the reference are ``long`` here (fixture keys); nothing in
the package generates ids at random.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must equal the reference's; stated once, in natural order)
# --------------------------------------------------------------------------

# complaint_status enum, in declaration order (PostgreSQL sorts by it).
STATUSES = ["submitted", "acknowledged", "assigned", "in_progress", "resolved", "closed", "rejected"]

# complaint_priority enum in declaration order, plus 'high' which the
# community escalation writes (decision D3: normal < high < urgent < emergency).
PRIORITIES = ["normal", "high", "urgent", "emergency"]

# Statuses an officer may set through the status route.
SETTABLE_STATUSES = ["acknowledged", "assigned", "in_progress", "resolved", "rejected"]

# Statuses that stop the SLA clock (overdue flag is false for them).
FINISHED_STATUSES = ["resolved", "closed", "rejected"]

# Statuses the hourly escalation skips (literal list of the escalation query).
ESCALATION_EXCLUDED = ["resolved", "rejected"]

# Departments whose complaints are public by default.
PUBLIC_DEPARTMENTS = [1, 2, 3, 5, 6]

# Seed departments: (name, name_te, code, sla_days); id = row order from 1.
SEED_DEPARTMENTS = [
    ("Roads & Infrastructure", "రోడ్లు & మౌలిక సదుపాయాలు", "ROADS", 7),
    ("Water Supply & Sanitation", "నీటి సరఫరా & పారిశుద్ధ్యం", "WATER", 5),
    ("Electricity (APSPDCL)", "విద్యుత్ (APSPDCL)", "ELEC", 3),
    ("Health & Medical", "ఆరోగ్యం & వైద్యం", "HEALTH", 5),
    ("Education", "విద్య", "EDU", 10),
    ("Municipal Services", "పురపాలక సేవలు", "MUNI", 7),
    ("Revenue & Land", "రెవెన్యూ & భూమి", "REV", 14),
    ("Agriculture", "వ్యవసాయం", "AGRI", 10),
    ("Police", "పోలీసు", "POLICE", 3),
    ("Other", "ఇతరాలు", "OTHER", 7),
]
DEFAULT_SLA_DAYS = 7

# Complaint number: 'AP-' year '-' district code '-' sequence of at least 5 digits.
COMPLAINT_NO_PREFIX = "AP"
COMPLAINT_NO_DIGITS = 5

PAGE_SIZE = 20
RECENT_K = 10
TOP_ISSUES_K = 5
COMMUNITY_THRESHOLD = 10
MAX_FILES = 5
MAX_FILE_BYTES = 10 * 1024 * 1024
CODE_TTL_SECONDS = 10 * 60
PHONE_LENGTH = 10

# Notes of the timeline and the outbox
ESCALATION_NOTE = ("SLA Breached — Auto-escalated to Emergency priority. "
                   "Requires immediate attention.")
FILING_NOTE = "Complaint received"
OUTBOX_FILING_TEMPLATE = "Complaint registered: %s"

# Request limiters (limiter, window seconds, max requests, routes it guards).
# 'upvote' is declared but guards no route (decision D18).
RATE_LIMITS = [
    ("general", 15 * 60, 100, "*"),
    ("otp", 60 * 60, 5, "otp_send,otp_verify"),
    ("complaint", 60 * 60, 10, "file_complaint"),
    ("upvote", 60 * 60, 20, ""),
]

# Message templates keyed by (event, lang); Telugu and English texts are the
# same string (decision D22).  The portal's own name and address are not
# carried over: they are parameters here.  Placeholders, in order:
# filed: name, number; registered: none; the others: number.
PORTAL_NAME = "CivicDesk"
TRACK_URL = "civicdesk.example.org/track"
PORTAL_URL = "civicdesk.example.org"
REGION = "the region"
_FILED = ("Dear %s, your complaint has been registered on " + PORTAL_NAME + ". ID: %s. "
          "Track at " + TRACK_URL)
MESSAGE_TEMPLATES = [
    ("filed", "te", _FILED),
    ("filed", "en", _FILED),
    ("acknowledged", "*", "Your " + PORTAL_NAME + " complaint %s has been acknowledged by the officer."),
    ("in_progress", "*", "Work has started on your " + PORTAL_NAME + " complaint %s."),
    ("resolved", "*", "Your " + PORTAL_NAME + " complaint %s has been resolved. Thank you for using "
                      + PORTAL_NAME + "!"),
    ("registered", "*", "Welcome to " + PORTAL_NAME + "! Your complaint portal for " + REGION
                        + ". File complaints at " + PORTAL_URL),
    ("escalated", "*", "Your " + PORTAL_NAME + " complaint %s has passed its deadline and been "
                       "escalated to Emergency priority."),
]
# Fixed value: the note of a community escalation
COMMUNITY_NOTE_TEMPLATE = ("Community escalated — %d citizens have upvoted this complaint. "
                           "Priority raised to High.")

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------

S, I, L, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, typ, nullable) for name, typ, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "districts": _schema(("id", I, False), ("name", S, False), ("name_te", S, True), ("code", S, False)),
    "mandals": _schema(("id", I, False), ("district_id", I, True), ("name", S, False), ("name_te", S, True)),
    "departments": _schema(("id", I, False), ("name", S, False), ("name_te", S, True), ("code", S, False),
                           ("sla_days", I, True), ("email", S, True), ("is_active", B, True)),
    "citizens": _schema(("id", L, False), ("name", S, False), ("phone", S, False), ("email", S, True),
                        ("aadhaar_hash", S, True), ("district_id", I, True), ("mandal_id", I, True),
                        ("village", S, True), ("lang_pref", S, True), ("created_at", TS, True),
                        ("last_login", TS, True)),
    "complaints": _schema(("id", L, False), ("complaint_no", S, False), ("citizen_id", L, True),
                          ("department_id", I, False), ("district_id", I, False), ("mandal_id", I, True),
                          ("village", S, True), ("title", S, False), ("description", S, False),
                          ("priority", S, True), ("latitude", T.DecimalType(10, 8), True),
                          ("longitude", T.DecimalType(11, 8), True), ("address", S, True),
                          ("status", S, True), ("assigned_to", I, True), ("sla_deadline", TS, True),
                          ("is_overdue", B, True), ("is_anonymous", B, True), ("source", S, True),
                          ("created_at", TS, True), ("updated_at", TS, True), ("resolved_at", TS, True),
                          ("closed_at", TS, True), ("is_public", B, True), ("upvote_count", I, True)),
    "attachments": _schema(("id", L, False), ("complaint_id", L, True), ("file_url", S, False),
                           ("file_type", S, True), ("file_size_kb", I, True), ("uploaded_at", TS, True)),
    "officers": _schema(("id", I, False), ("name", S, False), ("email", S, False), ("phone", S, True),
                        ("department_id", I, True), ("district_id", I, True), ("role", S, True),
                        ("is_active", B, True), ("created_at", TS, True), ("last_login", TS, True)),
    "timeline": _schema(("id", L, False), ("complaint_id", L, True), ("status", S, False), ("note", S, True),
                        ("updated_by", I, True), ("created_at", TS, True)),
    "notifications": _schema(("id", L, False), ("complaint_id", L, True), ("citizen_id", L, True),
                             ("channel", S, False), ("message", S, False), ("status", S, True),
                             ("sent_at", TS, True)),
    "upvotes": _schema(("id", L, False), ("complaint_id", L, True), ("voter_ip", S, True),
                       ("voted_at", TS, True)),
}

TABLES = list(SCHEMAS)


@dataclass
class Model:
    """One consistent snapshot of every table plus the report clock."""

    districts: DataFrame
    mandals: DataFrame
    departments: DataFrame
    citizens: DataFrame
    officers: DataFrame
    complaints: DataFrame
    attachments: DataFrame
    timeline: DataFrame
    notifications: DataFrame
    upvotes: DataFrame
    as_of: datetime
    extra: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def replace(self, **changes) -> "Model":
        values = {name: getattr(self, name) for name in TABLES}
        values.update(as_of=self.as_of, extra=dict(self.extra))
        if "complaints" in changes:
            for name in ("described", "described_by"):  # they belong to the complaints that are replaced
                values["extra"].pop(name, None)
        for kind in ("rows", "made"):
            values["extra"][kind] = {name: one for name, one in self.extra.get(kind, {}).items() if name not in changes}
        values.update(changes)
        return Model(**values)

    def rows(self, name: str) -> int:
        """About how many rows a table has; ``extra["rows"]`` counts one that takes joins to make by what it is made of."""
        return self.extra.get("rows", {}).get(name, getattr(self, name).count)()

    def made(self, name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A table for one pass over all of it; ``extra["made"]`` makes one with ``keep`` storing what it reads repeatedly."""
        make = self.extra.get("made", {}).get(name)
        return keep(make(keep)) if make else getattr(self, name)

    def brief(self) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """The complaints, and what adds ``description`` to rows made of them: where the texts are a table of their own
        (``extra["described"]``), they are joined after all else, so that no join or window before moves them.
        ``extra["described_by"]`` names the column that they are joined by."""
        return self.extra.get("described") or (self.complaints, lambda rows: rows)


def seed_departments(spark: SparkSession) -> DataFrame:
    """SRC-02: the ten default departments (id = seed row order)."""
    # A VALUES relation (LocalRelation): planned as a local table scan, no
    # Python-side RDD, and small enough for Catalyst to fold into joins.
    def q(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({i + 1}, {q(name)}, {q(name_te)}, {q(code)}, {sla}, CAST(NULL AS STRING), TRUE)"
                     for i, (name, name_te, code, sla) in enumerate(SEED_DEPARTMENTS))
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, name, name_te, code, sla_days, email, is_active)")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["departments"]])


def message_templates(spark: SparkSession) -> DataFrame:
    from civiccases.functions.expr import literal_table
    return literal_table(spark, MESSAGE_TEMPLATES, "event string, lang string, template string")


def rate_limits(spark: SparkSession, limits=None) -> DataFrame:
    from civiccases.functions.expr import literal_table
    return literal_table(spark, limits or RATE_LIMITS,
                         "limiter string, window_seconds long, max_requests long, routes string")


def filed_between(complaints: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Complaints created in [start, end); of a loaded snapshot only the years' folders are read."""
    at = F.col("created_at")
    rows = complaints.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))
    return rows.where(F.col("created_year").between(start.year, end.year)) if "created_year" in rows.columns else rows


def load_model(spark: SparkSession, model_dir: str, as_of: datetime) -> Model:
    """SRC-01: typed load of a model snapshot written by ``sinks.write_snapshot``.

    Schemas are given to the reader, never inferred; officers' password hashes
    are not part of the schema, so they are never read.  Complaints keep the
    partition column ``created_year`` for filters (``filed_between``).
    """
    frames = {}
    for name in TABLES:
        schema = SCHEMAS[name] if name != "complaints" else T.StructType([*SCHEMAS[name], T.StructField("created_year", I)])
        frames[name] = spark.read.schema(schema).parquet(f"{model_dir}/{name}")
    return Model(**frames, as_of=as_of)
