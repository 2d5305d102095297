"""Control charts, CUSUM, daily anomalies, monthly demand and drift.

Facts are folded to weeks, days or months first. A calendar holds at most some thousand of those, so
the windows over the whole folded table are small however many cases there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from casemill.functions.numbers import round_to
from casemill.schema import IQR_FENCE

# Limits in standard errors, range-chart factors for subgroups of five, specification, CUSUM.
SIGMAS = 3.0
RANGE_LOW, RANGE_HIGH = 0.0, 2.114
SPEC_LOW, SPEC_HIGH = 0.0, 10.0
CUSUM_DECISION = 4.77
CUSUM_SHIFT = 1.0
DRIFT_TOLERANCE = 0.10


def weekly_subgroups(df: DataFrame, day: str = "opened_on", value: str = "handling_days") -> DataFrame:
    """(week, n, mean, range, variance) of weeks with at least two values."""
    v = F.col(value)
    return (
        df.where(F.col(day).isNotNull() & v.isNotNull())
        .groupBy(F.trunc(day, "week").alias("week"))
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            (F.max(v) - F.min(v)).alias("range"),
            F.var_samp(v).alias("variance"),
        )
        .where(F.col("n") > 1)
    )


def _process(weeks: DataFrame) -> DataFrame:
    """One row: centre lines and the pooled spread inside weeks."""
    return weeks.agg(
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("centre"),
        F.avg("range").alias("range_centre"),
        F.sqrt(F.sum(F.col("variance") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("sigma"),
        F.count(F.lit(1)).alias("subgroups"),
    )


def control_chart(weeks: DataFrame) -> DataFrame:
    """Each week with its mean and range limits; weeks of unequal size get limits of their own width."""
    half = SIGMAS * F.col("sigma") / F.sqrt("n")
    return (
        weeks.crossJoin(F.broadcast(_process(weeks)))  # exactly one row
        .select(
            "week",
            "n",
            round_to(F.col("mean"), 4).alias("mean"),
            round_to(F.col("range"), 4).alias("range"),
            round_to(F.col("centre"), 4).alias("centre"),
            round_to(F.col("centre") - half, 4).alias("lcl"),
            round_to(F.col("centre") + half, 4).alias("ucl"),
            (F.abs(F.col("mean") - F.col("centre")) > half).alias("out_of_control"),
            (
                (F.col("range") > RANGE_HIGH * F.col("range_centre")) | (F.col("range") < RANGE_LOW * F.col("range_centre"))
            ).alias("range_out_of_control"),
        )
        .orderBy("week")
    )


def capability(weeks: DataFrame, low: float = SPEC_LOW, high: float = SPEC_HIGH) -> DataFrame:
    """One row: process centre, spread, Cp and Cpk against the specification."""
    sigma, centre = F.col("sigma"), F.col("centre")
    spread = F.nullif(sigma, F.lit(0.0))
    return _process(weeks).select(
        "subgroups",
        round_to(centre, 4).alias("centre"),
        round_to(sigma, 4).alias("sigma"),
        round_to(F.lit(high - low) / (6.0 * spread), 4).alias("cp"),
        round_to(F.least(F.lit(high) - centre, centre - F.lit(low)) / (3.0 * spread), 4).alias("cpk"),
    )


def cusum(weeks: DataFrame, decision: float = CUSUM_DECISION, shift: float = CUSUM_SHIFT) -> DataFrame:
    """Upper and lower cumulative sums of the standardised weekly means, flagged beyond the decision interval.

    ``S = max(0, S_before + x)`` equals the running sum minus the lowest running sum so far (zero included).
    """
    z = (F.col("mean") - F.col("centre")) / (F.col("sigma") / F.sqrt("n"))
    ordered = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    scored = weeks.crossJoin(F.broadcast(_process(weeks))).select(  # exactly one row
        "week", (z - shift / 2.0).alias("_up"), (-z - shift / 2.0).alias("_down")
    )
    sums = scored.select(
        "week", F.sum("_up").over(ordered).alias("_su"), F.sum("_down").over(ordered).alias("_sd")
    )
    upper = F.col("_su") - F.least(F.lit(0.0), F.min("_su").over(ordered))
    lower = F.col("_sd") - F.least(F.lit(0.0), F.min("_sd").over(ordered))
    return sums.select(
        "week",
        round_to(upper, 4).alias("upper"),
        round_to(lower, 4).alias("lower"),
        (F.greatest(upper, lower) > decision).alias("shift_detected"),
    ).orderBy("week")


def daily_anomalies(df: DataFrame, day: str = "opened_on", fence: float = IQR_FENCE) -> DataFrame:
    """Days whose volume, after trend and weekday effect, lies outside the quartile fences.

    Trend is the centred seven-day mean, the weekday effect the median of what remains on that weekday.
    """
    daily = df.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("volume"))
    number = F.unix_date("day")
    centred = Window.orderBy(number).rangeBetween(-3, 3)
    trended = daily.withColumn("trend", F.avg("volume").over(centred)).withColumn(
        "detrended", F.col("volume") - F.col("trend")
    )
    weekday = F.dayofweek("day")
    effect = trended.groupBy(weekday.alias("_weekday")).agg(F.percentile("detrended", F.lit(0.5)).alias("season"))
    remainders = trended.join(effect, weekday == F.col("_weekday")).withColumn(
        "remainder", F.col("detrended") - F.col("season")
    )
    quartiles = remainders.agg(F.percentile("remainder", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    below = F.col("remainder") < low - fence * (high - low)
    above = F.col("remainder") > high + fence * (high - low)
    return (
        remainders.crossJoin(F.broadcast(quartiles))  # exactly one row
        .where(below | above)
        .select(
            "day",
            "volume",
            round_to(F.col("trend") + F.col("season"), 4).alias("expected"),
            round_to(F.col("remainder"), 4).alias("remainder"),
            F.when(above, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
        )
        .orderBy("day")
    )


def monthly_demand(df: DataFrame) -> DataFrame:
    """Per month: cases, top cause, top channel, mean handling time."""
    month = F.trunc("opened_on", "month").alias("month")
    dated = df.where(F.col("opened_on").isNotNull())
    totals = dated.groupBy(month).agg(
        F.count(F.lit(1)).alias("total_count"), round_to(F.avg("handling_days"), 2).alias("avg_days")
    )

    def leader(column: str, name: str) -> DataFrame:
        counts = dated.where(F.col(column).isNotNull()).groupBy(month, column).agg(F.count(F.lit(1)).alias("n"))
        first = F.min(F.struct((-F.col("n")).alias("neg"), F.col(column).alias("name")))
        return counts.groupBy("month").agg(first.alias("_top")).select("month", F.col("_top.name").alias(name))

    return (
        totals.join(leader("cause", "top_cause"), "month", "left")
        .join(leader("channel", "top_channel"), "month", "left")
        .orderBy("month")
    )


def category_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, share) of the non-null values of each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    counted = (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counted.groupBy("column_name").agg(F.sum("n").alias("total"))
    return counted.join(totals, "column_name").select(
        "column_name", "value", (F.col("n") / F.col("total")).alias("share")
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] = ("handling_days",)) -> DataFrame:
    """(column_name, mean, std) of numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column_name").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def drift_check(
    source: DataFrame, other: DataFrame, columns: Sequence[str], tolerance: float = DRIFT_TOLERANCE
) -> DataFrame:
    """Category shares of two tables side by side; ``within`` allows a relative difference of a tenth."""
    left = category_shares(source, columns).withColumnRenamed("share", "_a")
    right = category_shares(other, columns).withColumnRenamed("share", "_b")
    a, b = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    relative = F.abs(b - a) / F.nullif(a, F.lit(0.0))
    return left.join(right, ["column_name", "value"], "full").select(
        "column_name",
        "value",
        round_to(a, 6).alias("source_share"),
        round_to(b, 6).alias("other_share"),
        round_to(relative, 4).alias("relative_difference"),
        F.coalesce(relative <= tolerance, F.lit(False)).alias("within"),
    )
