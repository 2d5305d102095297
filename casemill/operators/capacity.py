"""Work capacity of people and teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.severity import alert_level

# Team defaults.
MONTHLY_HOURS = 160.0
DEDICATION = 0.20
PRODUCTIVITY = 0.85


def _checked(value: Column, valid: Column, message: str) -> Column:
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)))


def net_capacity(hours: Column, factor: Column) -> Column:
    """Hours times productivity factor; negative hours or a factor outside (0, 1] are errors."""
    return _checked(hours, hours >= 0, "hours must not be negative") * _checked(
        factor, (factor > 0) & (factor <= 1), "productivity factor must lie in (0, 1]"
    )


def utilization(load: Column, net: Column) -> Column:
    """Load as a percentage of net capacity; without capacity 0 when idle, else 100."""
    load = _checked(load, load >= 0, "load must not be negative")
    return F.when(net > 0, load / net * 100.0).when(load == 0, F.lit(0.0)).otherwise(F.lit(100.0))


def _with_usage(df: DataFrame, load: str) -> DataFrame:
    return df.withColumn("utilization", utilization(F.col(load), F.col("net_capacity"))).withColumn(
        "alert_level", alert_level(F.col("utilization"))
    )


def capacity_by_user(df: DataFrame) -> DataFrame:
    """Add net capacity, utilisation and alert level to (hours, productivity_factor, assigned_work)."""
    net = net_capacity(F.col("hours"), F.col("productivity_factor"))
    return _with_usage(df.withColumn("net_capacity", net), "assigned_work")


def capacity_by_team(df: DataFrame) -> DataFrame:
    """Add available hours, net capacity, utilisation and level to team rows.

    Reads analysts and current_load; monthly_hours_base, dedication and productivity_factor where
    present, else their defaults.
    """

    def given(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    analysts = _checked(F.col("analysts"), F.col("analysts") > 0, "analysts must be positive")
    share = given("dedication", DEDICATION)
    share = _checked(share, share.between(0, 1), "dedication must lie in [0, 1]")
    teams = df.withColumn("available_hours", analysts * given("monthly_hours_base", MONTHLY_HOURS) * share)
    net = net_capacity(F.col("available_hours"), given("productivity_factor", PRODUCTIVITY))
    return _with_usage(teams.withColumn("net_capacity", net), "current_load")


def capacity_report(df: DataFrame) -> DataFrame:
    """One row: people, summed capacity and load, overall utilisation and level."""
    net = net_capacity(F.col("hours"), F.col("productivity_factor"))
    row = df.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.coalesce(F.sum(net), F.lit(0.0)).alias("net_capacity"),
        F.coalesce(F.sum("assigned_work"), F.lit(0.0)).cast("double").alias("assigned_work"),
    )
    return _with_usage(row, "assigned_work")
