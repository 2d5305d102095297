"""Expectation checks: compare a table with known reference figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import count_when, round_to, share
from casemill.functions.text import PHONE_WORDS, VERBAL_WORDS, contains_any, is_blank, strip


@dataclass(frozen=True)
class Expectations:
    """Expected figures and tolerances."""

    records: int = 51_008
    records_tolerance_pct: float = 1.0
    columns: int = 29
    columns_tolerance: int = 2
    max_duplication_pct: float = 1.0
    main_cause_pct: float = 50.0
    main_cause_tolerance: float = 5.0
    mean_days: float = 6.32
    mean_tolerance: float = 0.5
    median_days: float = 7.0
    median_tolerance: float = 1.0
    p90_days: float = 10.0
    p90_tolerance: float = 1.0
    phone_verbal_min_pct: float = 60.0

    @property
    def record_bounds(self) -> tuple[int, int]:
        part = self.records_tolerance_pct / 100
        return int(self.records * (1 - part)), int(self.records * (1 + part))


def _collapsing_rows(df: DataFrame, column: str) -> DataFrame:
    """One row: rows whose category has another spelling that differs in case or outer blanks only."""
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.lower(strip(F.col("v"))).alias("norm"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"))
    )
    return counted.agg(F.coalesce(F.sum(F.when(F.col("spellings") > 1, F.col("n"))), F.lit(0)).alias("collapsing"))


def reference_checks(df: DataFrame, expected: Expectations = Expectations()) -> DataFrame:
    """Rows (name, expected, actual, within, deviation), one per check."""
    low, high = expected.record_bounds
    time = F.col("handling_days").cast("double")
    channel, company = F.col("channel"), F.col("company")
    counters = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(time).alias("_mean"),
        F.percentile(time, F.array(F.lit(0.5), F.lit(0.9))).alias("_p"),
        count_when(contains_any(channel, PHONE_WORDS)).alias("phone"),
        count_when(contains_any(channel, VERBAL_WORDS)).alias("verbal"),
        count_when(is_blank(F.col("close_reason"))).alias("no_reason"),
        count_when(is_blank(F.col("marking"))).alias("no_marking"),
        count_when(company.isNull() | (company != strip(company))).alias("odd_company"),
    )
    ids = df.select("case_id").groupBy("case_id").agg(F.lit(1).alias("_")).agg(F.count("case_id").alias("ids"))
    top = (
        df.groupBy("cause")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("cause").isNotNull())
        .agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    )
    row = (
        counters.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(top))  # one row each
        .crossJoin(F.broadcast(_collapsing_rows(df, "cause")))
    )
    n = F.col("n")

    def pct(part: Column) -> Column:
        return F.coalesce(round_to(share(part, n), 2), F.lit(0.0))

    def check(name: str, wanted: float | None, actual: Column, within: Column) -> Column:
        target = F.lit(wanted).cast("double")
        return F.struct(
            F.lit(name).alias("name"),
            target.alias("expected"),
            actual.cast("double").alias("actual"),
            F.coalesce(within, F.lit(False)).alias("within"),
            round_to(actual.cast("double") - target, 2).alias("deviation"),
        )

    def near(name: str, wanted: float, tolerance: float, actual: Column) -> Column:
        return check(name, wanted, actual, actual.between(wanted - tolerance, wanted + tolerance))

    repeated = share(n - F.col("ids"), n)
    both = round_to(pct(F.col("phone")) + pct(F.col("verbal")), 2)
    yes = F.lit(True)
    width = F.lit(len(df.columns))
    checks = [
        check("record_count", expected.records, n, n.between(low, high)),
        near("column_count", expected.columns, expected.columns_tolerance, width),
        check(
            "duplication_rate", expected.max_duplication_pct, pct(n - F.col("ids")),
            F.coalesce(repeated < expected.max_duplication_pct, yes),
        ),
        near("main_cause_share", expected.main_cause_pct, expected.main_cause_tolerance, pct(F.col("top"))),
        near("handling_mean", expected.mean_days, expected.mean_tolerance, round_to(F.col("_mean"), 2)),
        near("handling_median", expected.median_days, expected.median_tolerance, round_to(F.col("_p")[0], 2)),
        near("handling_p90", expected.p90_days, expected.p90_tolerance, round_to(F.col("_p")[1], 2)),
        check("phone_verbal_share", expected.phone_verbal_min_pct, both, both > expected.phone_verbal_min_pct),
        check("close_reason_missing", None, pct(F.col("no_reason")), yes),
        check("marking_missing", None, pct(F.col("no_marking")), yes),
        check("company_inconsistent", None, pct(F.col("odd_company")), yes),
        check("category_duplicated", None, pct(F.col("collapsing")), yes),
    ]
    return row.select(F.inline(F.array(*checks)))


def check_summary(checks: DataFrame) -> DataFrame:
    """One row: how many checks passed and failed, and whether all passed."""
    failed = count_when(~F.col("within"))
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        count_when(F.col("within")).alias("passed"),
        failed.alias("failed"),
        (failed == 0).alias("all_passed"),
    )
