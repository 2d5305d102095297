"""Audit log: filtered pages and the append-only check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemill.operators.requests import page


def filter_audit(
    events: DataFrame,
    date_start: str | None = None,
    date_end: str | None = None,
    user_id: str | None = None,
    action: str | None = None,
    resource: str | None = None,
) -> DataFrame:
    """Events that meet every given condition; both ends of the time range belong to it."""
    rows = events
    kind = events.schema["timestamp"].dataType
    if date_start:
        rows = rows.where(F.col("timestamp") >= F.lit(date_start).cast(kind))
    if date_end:
        rows = rows.where(F.col("timestamp") <= F.lit(date_end).cast(kind))
    for name, value in (("user_id", user_id), ("action", action), ("resource", resource)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def query_audit(events: DataFrame, number: int = 1, size: int = 50, **conditions: str) -> DataFrame:
    """Newest matching events, one page, with the total beside each row."""
    return page(filter_audit(events, **conditions), [F.desc("timestamp"), F.desc("event_id")], number, size)


def append_only_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the older snapshot that the newer one has lost or changed."""
    return old.exceptAll(new.select(*old.columns))
