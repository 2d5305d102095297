"""Conjunctive case filter, its validation, filter options and result metadata."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MAX_LIST_VALUES = 100
# Filter field -> case column.
LIST_FIELDS = {
    "companies": "company",
    "causes": "cause",
    "channels": "channel",
    "statuses": "status",
    "outcomes": "outcome",
    "owner_units": "owner_unit",
}


@dataclass(frozen=True)
class CaseFilter:
    """Ten optional conditions joined by AND. An empty list or None means no condition."""

    date_start: str | None = None
    date_end: str | None = None
    companies: tuple[str, ...] = ()
    causes: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    outcomes: tuple[str, ...] = ()
    owner_units: tuple[str, ...] = ()
    time_min: float | None = None
    time_max: float | None = None

    @property
    def active(self) -> bool:
        return any(getattr(self, f.name) not in (None, ()) for f in fields(self))

    def conditions(self) -> list[Column]:
        found: list[Column] = []
        if self.date_start:
            found.append(F.col("opened_on") >= F.lit(self.date_start).cast("date"))
        if self.date_end:
            found.append(F.col("opened_on") <= F.lit(self.date_end).cast("date"))
        for name, column in LIST_FIELDS.items():
            values = list(getattr(self, name))
            if values:
                found.append(F.col(column).isin(values))
        if self.time_min is not None:
            found.append(F.col("handling_days") >= F.lit(float(self.time_min)))
        if self.time_max is not None:
            found.append(F.col("handling_days") <= F.lit(float(self.time_max)))
        return found

    def validate(self) -> list[str]:
        """Every problem with the filter, empty when it is usable."""
        problems: list[str] = []
        days: dict[str, date] = {}
        for name in ("date_start", "date_end"):
            text = getattr(self, name)
            if text is None:
                continue
            try:
                if len(text) != 10:
                    raise ValueError(text)
                days[name] = date.fromisoformat(text)
            except ValueError:
                problems.append(f"{name}: not a calendar date (YYYY-MM-DD)")
        if len(days) == 2 and days["date_start"] > days["date_end"]:
            problems.append("date_start is after date_end")
        numbers: dict[str, float] = {}
        for name in ("time_min", "time_max"):
            value = getattr(self, name)
            if value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf"):
                problems.append(f"{name}: must be a number of at least 0")
            else:
                numbers[name] = value
        if len(numbers) == 2 and numbers["time_min"] > numbers["time_max"]:
            problems.append("time_min is greater than time_max")
        for name in LIST_FIELDS:
            if len(getattr(self, name)) > MAX_LIST_VALUES:
                problems.append(f"{name}: more than {MAX_LIST_VALUES} values")
        return problems


def apply_filters(df: DataFrame, case_filter: CaseFilter) -> DataFrame:
    """Rows that meet every active condition; plain comparisons, so they reach the Parquet scan."""
    problems = case_filter.validate()
    if problems:
        raise ValueError("; ".join(problems))
    conditions = case_filter.conditions()
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def with_metadata(df: DataFrame, case_filter: CaseFilter) -> DataFrame:
    """One row: how many records pass the filter and whether any filter is active."""
    return apply_filters(df, case_filter).agg(
        F.count(F.lit(1)).alias("record_count"), F.lit(case_filter.active).alias("filtered")
    )


def filter_options(df: DataFrame, dimensions: tuple[str, ...] = tuple(LIST_FIELDS.values())) -> DataFrame:
    """Distinct values per filter dimension in long form, in one pass over the table.

    Each row turns into one (dimension, value) pair per dimension, and partial aggregation folds
    the pairs before the shuffle, so no list of values is held in one task.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.dimension", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("dimension", "value")
    )


def filter_limits(df: DataFrame) -> DataFrame:
    """Largest handling time, zero for an empty table."""
    return df.agg(F.coalesce(F.max("handling_days"), F.lit(0.0)).alias("handling_days_max"))
