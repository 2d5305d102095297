"""Backlog age, velocity, service-level alerts and analyst productivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import count_when, round_to, share
from casemill.operators.charts import suppress
from casemill.schema import CLOSED, MIN_GROUP

# Age bounds, default service level, look-back and alert days, escalation hours.
AGE_BOUNDS = (5, 10, 20, 30)
SLA_DAYS = 15
VELOCITY_DAYS = 7
ALERT_DAYS = 3
CRITICAL_HOURS = 48
REMINDER_HOURS = 24


def open_cases(df: DataFrame, as_of: Column, sla_days: Column | None = None) -> DataFrame:
    """Open cases with days open, overdue flag and days to breach; cases opened later are left out."""
    limit = F.lit(SLA_DAYS) if sla_days is None else sla_days
    age = F.datediff(as_of, F.col("opened_on"))
    return (
        df.where((F.col("status") != CLOSED) & (age >= 0))
        .withColumn("days_open", age)
        .withColumn("is_overdue", age > limit)
        .withColumn("days_to_breach", limit - age)
    )


def _age_bucket(age: Column, bounds: Sequence[int] = AGE_BOUNDS) -> tuple[Column, Column]:
    ordinal, label = F.lit(len(bounds) + 1), F.lit(f">{bounds[-1]} days")
    lows = [0, *[b + 1 for b in bounds[:-1]]]
    for place, (low, high) in reversed(list(enumerate(zip(lows, bounds), start=1))):
        ordinal = F.when(age <= high, F.lit(place)).otherwise(ordinal)
        label = F.when(age <= high, F.lit(f"{low}-{high} days")).otherwise(label)
    return ordinal, label


def backlog_ages(backlog: DataFrame) -> DataFrame:
    """Open cases per age bucket with percentage, youngest first."""
    ordinal, label = _age_bucket(F.col("days_open"))
    counted = backlog.groupBy(ordinal.alias("ordinal"), label.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("total"))
    return (
        counted.crossJoin(F.broadcast(total))  # exactly one row
        .select("ordinal", "bucket", "count", round_to(share(F.col("count"), F.col("total")), 1).alias("pct"))
        .orderBy("ordinal")
    )


def backlog_by(backlog: DataFrame, column: str, min_group: int = MIN_GROUP) -> DataFrame:
    """Open cases, mean age and overdue percentage per group."""
    grouped = backlog.dropna(subset=[column]).groupBy(column).agg(
        F.count(F.lit(1)).alias("count"),
        round_to(F.avg("days_open"), 1).alias("avg_age_days"),
        count_when(F.col("is_overdue")).alias("overdue_count"),
    )
    return (
        suppress(grouped, min_group)
        .withColumn("overdue_pct", round_to(share(F.col("overdue_count"), F.col("count")), 1))
        .orderBy(F.desc("count"), column)
    )


def backlog_summary(backlog: DataFrame) -> DataFrame:
    """One row: open cases, mean, median and 90th percentile of age, service-level compliance."""
    n, late = F.count(F.lit(1)), count_when(F.col("is_overdue"))
    age = F.col("days_open")

    def figure(c: Column) -> Column:
        return F.coalesce(round_to(c, 1), F.lit(0.0))

    return backlog.agg(
        n.alias("total_open_cases"),
        figure(F.avg(age)).alias("avg_age_days"),
        figure(F.percentile(age, F.lit(0.5))).alias("median_age_days"),
        figure(F.percentile(age, F.lit(0.9))).alias("p90_age_days"),
        figure(share(n - late, n)).alias("sla_compliance_pct"),
        late.alias("overdue_cases"),
    )


def backlog_velocity(df: DataFrame, as_of: Column, days: int = VELOCITY_DAYS) -> DataFrame:
    """Cases opened and closed in the days before a date, and the net change."""
    since = F.date_sub(as_of, days)
    opened = count_when((F.col("opened_on") > since) & (F.col("opened_on") <= as_of))
    closed = count_when((F.col("closed_on") > since) & (F.col("closed_on") <= as_of))
    return df.agg(opened.alias("opened"), closed.alias("closed"), (opened - closed).alias("net_change"))


def breach_risk(backlog: DataFrame, days: int = ALERT_DAYS) -> DataFrame:
    """One row: open cases that reach their limit within some days, and how far they are from it."""
    near = backlog.where(F.col("days_to_breach").between(0, days))
    return near.agg(
        F.count(F.lit(1)).alias("cases_at_risk"),
        F.coalesce(round_to(F.avg("days_to_breach"), 1), F.lit(0.0)).alias("avg_days_to_breach"),
    )


def escalations(df: DataFrame, as_of: Column, sla_days: int = SLA_DAYS) -> DataFrame:
    """Open cases past their deadline with level and addressee, and those due within a day as reminders."""
    deadline = F.date_add("opened_on", sla_days)
    hours = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(deadline.cast("timestamp"))) / 3600.0
    late, soon = F.col("hours_overdue") > 0, F.col("hours_overdue") > -REMINDER_HOURS
    critical = F.col("hours_overdue") > CRITICAL_HOURS
    level = (
        F.when(late & critical, F.lit("CRITICAL")).when(late, F.lit("NORMAL")).otherwise(F.lit("REMINDER"))
    )
    target = (
        F.when(F.col("level") == "CRITICAL", F.lit("VP_APPROVER"))
        .when(F.col("level") == "NORMAL", F.lit("OPERATIONS_LEAD"))
        .otherwise(F.lit("ANALYST"))
    )
    return (
        df.where(F.col("status") != CLOSED)
        .withColumn("hours_overdue", hours)
        .where(soon)
        .withColumn("level", level)
        .withColumn("escalate_to", target)
    )


def productivity(metrics: DataFrame) -> DataFrame:
    """Per analyst and role: throughput, resolution time, service level, rework rate and tier.

    ``metrics`` has one row per analyst and period: cases_resolved, avg_resolution_days,
    sla_compliance_pct, rework_count.
    """
    people = metrics.groupBy("analyst_id", "role").agg(
        F.sum("cases_resolved").alias("total_resolved"),
        F.avg("cases_resolved").alias("avg_throughput"),
        F.avg("avg_resolution_days").alias("avg_resolution"),
        F.avg("sla_compliance_pct").alias("sla_compliance"),
        share(F.sum("rework_count"), F.sum("cases_resolved")).alias("rework_rate"),
    )
    cuts = people.agg(F.percentile("avg_throughput", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    tier = (
        F.when(F.col("avg_throughput") >= F.col("_q")[1], F.lit("high_performer"))
        .when(F.col("avg_throughput") <= F.col("_q")[0], F.lit("needs_support"))
        .otherwise(F.lit("on_track"))
    )
    return people.crossJoin(F.broadcast(cuts)).withColumn("tier", tier).drop("_q")  # exactly one row


def productivity_by_role(people: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Head count and means per role; roles below the privacy minimum are left out."""
    grouped = people.groupBy("role").agg(
        F.count(F.lit(1)).alias("headcount"),
        round_to(F.avg("avg_throughput"), 2).alias("avg_throughput"),
        round_to(F.avg("avg_resolution"), 2).alias("avg_resolution_days"),
        round_to(F.avg("sla_compliance"), 2).alias("sla_compliance_pct"),
    )
    return suppress(grouped, min_group, "headcount").orderBy("role")
