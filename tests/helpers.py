"""Small in-memory models for the tests."""

from __future__ import annotations

from datetime import datetime

from civiccases.sources.model import SCHEMAS, Model, seed_departments

AS_OF = datetime(2024, 3, 10, 12, 0, 0)


def _rows(table: str, rows: list[dict]) -> list[tuple]:
    names = [f.name for f in SCHEMAS[table]]
    return [tuple(r.get(n) for n in names) for r in rows]


def complaint(**kw) -> dict:
    base = dict(id=1, complaint_no=f"AP-2024-D01-{kw.get('id', 1):05d}", citizen_id=None, department_id=1,
                district_id=1, mandal_id=None, village=None, title="t", description="d", priority="normal",
                latitude=None, longitude=None, address=None, status="submitted", assigned_to=None,
                sla_deadline=None, is_overdue=False, is_anonymous=False, source="web",
                created_at=datetime(2024, 3, 1), updated_at=datetime(2024, 3, 1), resolved_at=None,
                closed_at=None, is_public=True, upvote_count=0)
    base.update(kw)
    return base


def make_model(spark, complaints=(), citizens=(), officers=(), districts=None, mandals=(), timeline=(),
               attachments=(), notifications=(), upvotes=(), departments=None, as_of=AS_OF) -> Model:
    districts = districts if districts is not None else [
        dict(id=1, name="One", name_te=None, code="D01"), dict(id=2, name="Two", name_te=None, code="D02"),
        dict(id=3, name="Empty", name_te=None, code="D03")]
    frames = {
        "districts": spark.createDataFrame(_rows("districts", districts), SCHEMAS["districts"]),
        "mandals": spark.createDataFrame(_rows("mandals", list(mandals)), SCHEMAS["mandals"]),
        "departments": (seed_departments(spark) if departments is None else
                        spark.createDataFrame(_rows("departments", departments), SCHEMAS["departments"])),
        "citizens": spark.createDataFrame(_rows("citizens", list(citizens)), SCHEMAS["citizens"]),
        "officers": spark.createDataFrame(_rows("officers", list(officers)), SCHEMAS["officers"]),
        "complaints": spark.createDataFrame(_rows("complaints", list(complaints)), SCHEMAS["complaints"]),
        "attachments": spark.createDataFrame(_rows("attachments", list(attachments)), SCHEMAS["attachments"]),
        "timeline": spark.createDataFrame(_rows("timeline", list(timeline)), SCHEMAS["timeline"]),
        "notifications": spark.createDataFrame(_rows("notifications", list(notifications)),
                                               SCHEMAS["notifications"]),
        "upvotes": spark.createDataFrame(_rows("upvotes", list(upvotes)), SCHEMAS["upvotes"]),
    }
    return Model(**frames, as_of=as_of)
