"""Grouped chart aggregates. Groups below the privacy minimum never leave an operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import count_when, round_to, share
from casemill.schema import CLOSED, MIN_GROUP, OTHERS_LABEL

# Upper bounds (inclusive) and labels of the open-case age histogram.
AGE_BUCKETS = ((7, "0-7"), (14, "8-14"), (21, "15-21"), (28, "22-28"), (60, "29-60"))
AGE_OVERFLOW = "61+"
COMPLETENESS_FIELDS = (
    "cause",
    "company",
    "channel",
    "status",
    "outcome",
    "close_reason",
    "marking",
    "owner_unit",
    "handling_days",
)


def suppress(df: DataFrame, min_group: int = MIN_GROUP, count: str = "count") -> DataFrame:
    """Drop groups that are too small to show."""
    return df.where(F.col(count) >= min_group)


def group_counts(
    df: DataFrame, *keys: str, min_group: int = MIN_GROUP, keep_null: bool = False
) -> DataFrame:
    """Row count per key tuple after suppression."""
    rows = df if keep_null else df.dropna(subset=list(keys))
    return suppress(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")), min_group)


def distribution(
    df: DataFrame, column: str, min_group: int = MIN_GROUP, keep_null: bool = False
) -> DataFrame:
    """Counts by one column, largest first."""
    return (
        group_counts(df, column, min_group=min_group, keep_null=keep_null)
        .select(F.col(column).alias("category"), "count")
        .orderBy(F.desc("count"), "category")
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of an order that ends in a unique column; executed as a bounded heap per task."""
    return df.orderBy(*order).limit(k)


def top_causes(df: DataFrame, n: int = 10, min_group: int = MIN_GROUP) -> DataFrame:
    return top_k(group_counts(df, "cause", min_group=min_group), [F.desc("count"), F.col("cause")], n)


def largest_group(df: DataFrame, column: str, min_group: int = MIN_GROUP) -> DataFrame:
    """One row: largest surviving group (first by name on ties) and the total of all of them."""
    groups = group_counts(df, column, min_group=min_group)
    # The smallest of (-count, name) is the largest count, first by name.
    return groups.agg(
        F.min(F.struct((-F.col("count")).alias("neg"), F.col(column).alias("name"))).alias("top"),
        F.sum("count").alias("total"),
    ).select(
        F.col("top.name").alias("name"),
        (-F.col("top.neg")).alias("count"),
        "total",
    ).where(F.col("total").isNotNull())


def top_vs_rest(df: DataFrame, column: str = "cause", others: str = OTHERS_LABEL) -> DataFrame:
    """Two rows: the largest group and everything else."""
    rest = F.col("total") - F.col("count")
    rows = F.array(
        F.struct(F.col("name").alias("category"), F.col("count").alias("count")),
        F.struct(F.lit(others).alias("category"), rest.alias("count")),
    )
    return (
        largest_group(df, column)
        .select("total", F.inline(rows))
        .select("category", "count", round_to(share(F.col("count"), F.col("total")), 2).alias("percentage"))
    )


def monthly_trend(df: DataFrame, text: bool = False, min_group: int = MIN_GROUP) -> DataFrame:
    """Cases opened per month, as first day of the month or as ``YYYY-MM`` text."""
    month = (
        F.date_format("opened_on", "yyyy-MM") if text else F.trunc("opened_on", "month")
    )
    return group_counts(df.select(month.alias("period")), "period", min_group=min_group).orderBy("period")


def _box(value: Column) -> list[Column]:
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [quartiles.alias("_q"), F.min(value).alias("_lo"), F.max(value).alias("_hi")]


def _box_columns() -> list[Column]:
    return [
        round_to(F.col("_q")[0], 2).alias("q1"),
        round_to(F.col("_q")[1], 2).alias("median"),
        round_to(F.col("_q")[2], 2).alias("q3"),
        round_to(F.col("_lo"), 2).alias("whisker_low"),
        round_to(F.col("_hi"), 2).alias("whisker_high"),
    ]


def handling_box(df: DataFrame, n: int = 10, min_group: int = MIN_GROUP) -> DataFrame:
    """Box-plot figures of the n most frequent causes, slowest median first.

    The figures are taken for every cause in the pass that counts them, so the facts are read once
    and need no join with the list of top causes.
    """
    per_cause = (
        df.dropna(subset=["cause"])
        .groupBy("cause")
        .agg(F.count(F.lit(1)).alias("count"), *_box(F.col("handling_days")))
    )
    top = top_k(suppress(per_cause, min_group), [F.desc("count"), F.col("cause")], n)
    return top.select("cause", *_box_columns()).orderBy(F.desc("median"), "cause")


def overall_box(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("handling_days").isNotNull())
        .agg(F.count(F.lit(1)).alias("record_count"), *_box(F.col("handling_days")))
        .select(*_box_columns(), "record_count")
    )


def p90_by_cause(df: DataFrame, n: int = 10, min_group: int = MIN_GROUP) -> DataFrame:
    """The n causes with the highest 90th percentile of handling time."""
    stats = (
        df.dropna(subset=["cause", "handling_days"])
        .groupBy("cause")
        .agg(
            round_to(F.percentile("handling_days", F.lit(0.9)), 2).alias("p90"),
            F.count(F.lit(1)).alias("count"),
        )
    )
    return top_k(suppress(stats, min_group), [F.desc("p90"), F.col("cause")], n)


def heatmap(df: DataFrame, rows: str = "cause", columns: str = "channel") -> DataFrame:
    return group_counts(df, rows, columns).orderBy(F.desc("count"), rows, columns)


def open_age_histogram(df: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Open cases by age bucket, youngest first."""
    age = F.col("handling_days")
    ordinal = F.lit(len(AGE_BUCKETS) + 1)
    label = F.lit(AGE_OVERFLOW)
    for position, (bound, name) in reversed(list(enumerate(AGE_BUCKETS, start=1))):
        ordinal = F.when(age <= bound, F.lit(position)).otherwise(ordinal)
        label = F.when(age <= bound, F.lit(name)).otherwise(label)
    open_cases = df.where((F.col("status") != CLOSED) & age.isNotNull())
    counted = open_cases.groupBy(ordinal.alias("ordinal"), label.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return suppress(counted, min_group).orderBy("ordinal").select("bucket", "count")


def completeness_by_field(df: DataFrame, columns: Sequence[str] = COMPLETENESS_FIELDS) -> DataFrame:
    """Percentage of non-null values per column, from one pass, least complete first."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in columns])
    return (
        counted.select("n", F.inline(pairs))
        .select("column_name", round_to(share(F.col("present"), F.col("n")), 2).alias("completeness_pct"))
        .orderBy("completeness_pct", "column_name")
    )


def anomaly_matrix(
    df: DataFrame, rows: str = "cause", columns: str = "channel", limit: float = 2.0
) -> DataFrame:
    """z-score of every surviving cell against all surviving cells; flagged beyond the limit."""
    cells = group_counts(df, rows, columns)
    spread = cells.agg(F.avg("count").alias("mean"), F.stddev_samp("count").alias("std"))
    z = (F.col("count") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    return (
        cells.crossJoin(F.broadcast(spread))  # exactly one row
        .select(
            rows,
            columns,
            "count",
            round_to(z, 2).alias("z_score"),
            F.coalesce(F.abs(z) > limit, F.lit(False)).alias("is_anomaly"),
        )
        .orderBy(F.desc_nulls_last(F.abs("z_score")), rows, columns)
    )


def quality_issue_pct(df: DataFrame) -> DataFrame:
    """Percentage of rows without closing reason, marking or company."""
    missing = F.col("close_reason").isNull() | F.col("marking").isNull() | F.col("company").isNull()
    pct = share(count_when(missing), F.count(F.lit(1)))
    return df.agg(F.coalesce(round_to(pct, 1), F.lit(0.0)).alias("quality_issues_pct"))
