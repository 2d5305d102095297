"""Threshold ladders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def violation_severity(pct: Column) -> Column:
    """Severity of a violated rule by the percentage of rows it touches."""
    return (
        F.when(pct > 20, F.lit("critical"))
        .when(pct > 10, F.lit("high"))
        .when(pct > 5, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def null_severity(pct: Column) -> Column:
    """Severity of a column by its percentage of nulls."""
    return (
        F.when(pct > 20, F.lit("high")).when(pct >= 5, F.lit("medium")).otherwise(F.lit("low"))
    )


def alert_level(utilization: Column) -> Column:
    """Traffic light for a utilisation percentage."""
    return (
        F.when(utilization <= 85, F.lit("green"))
        .when(utilization <= 100, F.lit("yellow"))
        .when(utilization <= 120, F.lit("orange"))
        .otherwise(F.lit("red"))
    )
