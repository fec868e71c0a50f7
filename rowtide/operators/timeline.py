"""Timeline and detail of changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import rfc3339_column
from ..functions.predicates import Filter, Refused
from ..functions.values import display, unrenderable
from ..model import SCHEMA_CHANGE, op_name


def _summary() -> list:
    return [
        F.col("change_id").alias("id"),
        rfc3339_column(F.col("committed_at")).alias("moment"),
        F.col("schema_name").alias("schema"),
        F.col("table_name").alias("table"),
        op_name(F.col("op")).alias("op"),
        F.col("log_file"),
        F.col("log_pos"),
        F.coalesce("query", F.lit("")).alias("query"),
        (F.col("op") == SCHEMA_CHANGE).alias("schema_change"),
    ]


def timeline(changes: DataFrame) -> DataFrame:
    """What a timeline shows of a change; row images are not read."""
    return changes.select(*_summary())


def detail(changes: DataFrame) -> DataFrame:
    """A change with its images as text or null; an image that does not exist is null."""
    cells = F.concat(F.coalesce("before", F.array()), F.coalesce("after", F.array()))
    refusal = F.get(F.filter(F.transform(cells, unrenderable), lambda x: x.isNotNull()), F.lit(0))
    shown = F.transform("before", display).alias("before"), F.transform("after", display).alias("after")
    return changes.select(*_summary(), "columns", *shown, refusal.alias("refusal"))


def page(snapshot, f: Filter | None = None, before: int = 0, limit: int = 0, now: datetime | None = None) -> dict:
    """{changes: [...], next: cursor}; next only if the page is full."""
    from ..plans.store import page_limit

    rows = [r.asDict() for r in timeline(snapshot.page(f, before, limit, now)).orderBy(F.col("id").desc()).collect()]
    for r in rows:
        r["at"] = r.pop("moment")
    out: dict = {"changes": rows}
    if rows and len(rows) == page_limit(limit):
        out["next"] = rows[-1]["id"]
    return out


def one(snapshot, change_id: int) -> dict | None:
    """Detail of one change, or nothing; a value that cannot be shown is refused."""
    row = detail(snapshot.change(change_id)).first()
    if row is None:
        return None
    found = row.asDict(recursive=True)
    if refusal := found.pop("refusal"):
        raise Refused(f"change {change_id}: {refusal}")
    found["at"] = found.pop("moment")
    return found
