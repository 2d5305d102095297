"""Headline figures and main-cause lookups. The three share definitions differ in their denominator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import count_when, round_to, share
from casemill.operators.charts import group_counts, largest_group
from casemill.schema import CLOSED, IN_PROCESS, MIN_GROUP


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def kpis(df: DataFrame, in_process: Sequence[str] = (IN_PROCESS,)) -> DataFrame:
    """One row of headline figures in one pass; nulls become zero."""
    n = F.count(F.lit(1))
    time = F.col("handling_days")
    row = df.agg(
        n.alias("total"),
        count_when(F.col("status") == CLOSED).alias("closed"),
        count_when(F.col("status").isin(list(in_process))).alias("in_process"),
        F.avg(time).alias("_avg"),
        F.percentile(time, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("_p"),
        F.max(time).alias("_max"),
        F.count_distinct("cause").alias("distinct_causes"),
    )
    return row.select(
        "total",
        "closed",
        "in_process",
        _or_zero(round_to(share(F.col("closed"), F.col("total")), 1)).alias("percentage_closed"),
        _or_zero(round_to(F.col("_avg"), 1)).alias("avg_handling"),
        _or_zero(round_to(F.col("_p")[0], 1)).alias("median_handling"),
        _or_zero(round_to(F.col("_p")[1], 1)).alias("p90_handling"),
        _or_zero(round_to(F.col("_p")[2], 1)).alias("p95_handling"),
        _or_zero(round_to(F.col("_max"), 1)).alias("max_handling"),
        "distinct_causes",
    )


def main_cause_share(df: DataFrame, keep_null: bool = False, min_group: int = MIN_GROUP) -> DataFrame:
    """Largest cause as a percentage of all rows, those without a cause included; zero without groups."""
    groups = df.groupBy("cause").agg(F.count(F.lit(1)).alias("count"))
    shown = F.col("count") >= min_group
    if not keep_null:
        shown = shown & F.col("cause").isNotNull()
    pct = share(F.max(F.when(shown, F.col("count"))), F.sum("count"))
    return groups.agg(_or_zero(round_to(pct, 1)).alias("main_cause_share_pct"))


def main_cause(df: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Largest cause with its percentage of the surviving groups."""
    return largest_group(df, "cause", min_group).select(
        F.col("name").alias("cause"), "count", round_to(share(F.col("count"), F.col("total")), 2).alias("share_pct")
    )


def verify_table(df: DataFrame) -> DataFrame:
    """Load check: rows, columns, distinct causes and handling-time figures."""
    time = F.col("handling_days")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.count_distinct("cause").alias("distinct_causes"),
        round_to(F.avg(time), 2).alias("mean_days"),
        round_to(F.percentile(time, F.lit(0.5)), 2).alias("median_days"),
        round_to(F.percentile(time, F.lit(0.9)), 2).alias("p90_days"),
    )


def status_distribution(df: DataFrame) -> DataFrame:
    """Rows per status, nothing suppressed."""
    return group_counts(df, "status", min_group=1, keep_null=True).orderBy(F.desc("count"), "status")
