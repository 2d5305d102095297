"""Root-cause analytics: main cause, its profile, related causes, failure modes, automation estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import round_to, share
from casemill.functions.text import CANCEL_WORDS, contains_any, month_text
from casemill.operators.charts import group_counts
from casemill.schema import MAIN_CAUSE_CONFIRMED

MINUTES_PER_CASE = 15
DAYS_PER_MONTH = 30.44
# Automation estimates.
ELIMINABLE_PCT = 65.0
DAYS_SAVED = 2.5
STRAIGHT_THROUGH_SHARE = 0.65


def identify_main_cause(
    df: DataFrame, column: str = "cause", threshold: float = MAIN_CAUSE_CONFIRMED
) -> DataFrame:
    """One row: most frequent non-null cause, its share of non-null rows, confirmed from 45 %."""
    groups = group_counts(df, column, min_group=1)
    row = groups.agg(
        F.min(F.struct((-F.col("count")).alias("neg"), F.col(column).alias("name"))).alias("top"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
    )
    count = F.coalesce(-F.col("top.neg"), F.lit(0))
    portion = F.coalesce(count / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    confirmed = portion >= threshold
    verdict = F.when(confirmed, F.lit("confirmed")).otherwise(F.lit("not confirmed"))
    message = F.when(F.col("total") == 0, F.lit("no records with a cause")).otherwise(
        F.concat_ws(
            " ",
            F.lit("main cause"),
            F.col("top.name"),
            verdict.cast("string"),
            F.concat(F.lit("with "), count.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" records")),
        )
    )
    return row.select(
        F.coalesce("top.name", F.lit("")).alias("cause_name"),
        count.alias("record_count"),
        round_to(portion, 6).alias("percentage_share"),
        confirmed.alias("is_confirmed"),
        message.alias("validation_message"),
    )


def cause_summary(df: DataFrame, cause: str, column: str = "cause") -> DataFrame:
    """Volume of one cause and its share of the rows that have a cause."""
    volume = F.count(F.when(F.col(column) == cause, F.lit(1)))
    portion = volume / F.nullif(F.count(column), F.lit(0))
    return df.agg(
        F.lit(cause).alias("cause_name"),
        volume.alias("absolute_volume"),
        F.coalesce(round_to(portion, 6), F.lit(0.0)).alias("percentage_share"),
    )


def _of(df: DataFrame, cause: str) -> DataFrame:
    return df.where(F.col("cause") == cause)


def cause_trend(df: DataFrame, cause: str) -> DataFrame:
    """Cases of the cause per month."""
    months = _of(df, cause).where(F.col("opened_on").isNotNull()).select(month_text(F.col("opened_on")).alias("month"))
    return months.groupBy("month").agg(F.count(F.lit(1)).alias("count")).orderBy("month")


def _shares(df: DataFrame, column: str, scale: float, places: int, name: str) -> DataFrame:
    groups = group_counts(df, column, min_group=1)
    total = groups.agg(F.sum("count").alias("total"))
    return (
        groups.crossJoin(F.broadcast(total))  # exactly one row
        .select(column, "count", round_to(share(F.col("count"), F.col("total"), scale), places).alias(name))
        .orderBy(F.desc("count"), column)
    )


def cause_channels(df: DataFrame, cause: str) -> DataFrame:
    """Channel proportions of the cause among rows with a channel."""
    return _shares(_of(df, cause), "channel", 1.0, 4, "proportion")


def cause_outcomes(df: DataFrame, cause: str) -> DataFrame:
    """Outcome percentages of the cause among rows with an outcome."""
    return _shares(_of(df, cause), "outcome", 100.0, 2, "percentage")


def cause_time_stats(df: DataFrame, cause: str) -> DataFrame:
    """Mean, median and 90th percentile of handling time; zeros without values."""
    time = F.col("handling_days")

    def figure(c: Column) -> Column:
        return F.coalesce(round_to(c, 2), F.lit(0.0))

    return _of(df, cause).agg(
        figure(F.avg(time)).alias("mean"),
        figure(F.percentile(time, F.lit(0.5))).alias("median"),
        figure(F.percentile(time, F.lit(0.9))).alias("p90"),
    )


def related_causes(df: DataFrame, main: str, words: tuple[str, ...] = CANCEL_WORDS) -> DataFrame:
    """Other causes whose name holds one of the words, with their share of rows that have a cause.

    ``combined_share`` adds up all matching causes, the main one included if it matches.
    """
    groups = group_counts(df, "cause", min_group=1)
    matches = contains_any(F.col("cause"), words)
    sums = groups.agg(
        F.sum("count").alias("total"), F.coalesce(F.sum(F.when(matches, F.col("count"))), F.lit(0)).alias("combined")
    )
    return (
        groups.where(matches & (F.col("cause") != main))
        .crossJoin(F.broadcast(sums))  # exactly one row
        .select(
            "cause",
            "count",
            round_to(F.col("count") / F.col("total"), 6).alias("share"),
            round_to(F.col("combined") / F.col("total"), 6).alias("combined_share"),
        )
        .orderBy(F.desc("count"), "cause")
    )


def operational_impact(df: DataFrame, cause: str, minutes: float = MINUTES_PER_CASE) -> DataFrame:
    """Manual hours per month: mean monthly volume times minutes per case; a twelfth of all rows without dates."""
    per_month = _of(df, cause).groupBy(month_text(F.col("opened_on")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    dated = F.col("month").isNotNull()
    monthly = F.coalesce(
        F.avg(F.when(dated, F.col("n"))), F.coalesce(F.sum("n"), F.lit(0)) / 12.0
    )
    return per_month.agg(round_to(monthly * F.lit(float(minutes)) / 60.0, 2).alias("hours_per_month"))


def failure_modes(modes: DataFrame) -> DataFrame:
    """Add the risk priority number; a rating outside 1 to 5 is an error."""
    ratings = [F.col(c) for c in ("severity", "occurrence", "detection")]
    bad = F.raise_error(F.lit("ratings must lie between 1 and 5"))
    in_range = ratings[0].between(1, 5) & ratings[1].between(1, 5) & ratings[2].between(1, 5)
    return modes.withColumn("rpn", F.when(in_range, ratings[0] * ratings[1] * ratings[2]).otherwise(bad))


def fmea(modes: DataFrame, order: str = "mode") -> DataFrame:
    """One row: total and mean risk priority and the highest mode, the first in ``order`` on ties."""
    scored = failure_modes(modes)
    top = F.min(F.struct((-F.col("rpn")).alias("neg"), F.col(order).alias("place"), F.col("mode").alias("mode")))
    return scored.agg(
        F.sum("rpn").cast("long").alias("total_rpn"),
        round_to(F.avg("rpn"), 2).alias("average_rpn"),
        top.alias("top"),
    ).select("total_rpn", "average_rpn", F.col("top.mode").alias("highest_mode"), (-F.col("top.neg")).cast("long").alias("highest_rpn"))


def automation_opportunity(
    df: DataFrame,
    cause: str,
    eliminable_pct: float = ELIMINABLE_PCT,
    days_saved: float = DAYS_SAVED,
    straight_through: float = STRAIGHT_THROUGH_SHARE,
) -> DataFrame:
    """Monthly volume of a cause from its date span, and the part that needs no manual work."""
    row = _of(df, cause).agg(
        F.count(F.lit(1)).alias("records"),
        F.min("opened_on").alias("_from"),
        F.max("opened_on").alias("_to"),
        F.avg("handling_days").alias("_avg"),
    )
    months = F.greatest(F.datediff("_to", "_from") / F.lit(DAYS_PER_MONTH), F.lit(1.0))
    monthly = (
        F.when(F.col("_from").isNull(), F.col("records") / 12.0)
        .when(F.col("_from") == F.col("_to"), F.col("records").cast("double"))
        .otherwise(F.col("records") / months)
    )
    return row.select(
        "records",
        round_to(monthly, 4).alias("monthly_volume"),
        F.lit(eliminable_pct).alias("eliminable_manual_pct"),
        F.lit(days_saved).alias("time_reduction_days"),
        (monthly * F.lit(straight_through)).cast("long").alias("stp_monthly_volume"),
        F.coalesce(round_to(F.col("_avg"), 1), F.lit(0.0)).alias("avg_days"),
    )


def findings(df: DataFrame) -> DataFrame:
    """Executive findings: the main cause with its share, and its handling times."""
    main = identify_main_cause(df)
    time = F.col("handling_days")
    per_cause = df.groupBy("cause").agg(
        F.avg(time).alias("_mean"), F.percentile(time, F.lit(0.9)).alias("_p90")
    )
    row = main.join(per_cause, main["cause_name"] == per_cause["cause"], "left")
    name = F.col("cause_name")

    def finding(description: Column, metric: str, severity: Column | str, action: Column | str) -> Column:
        return F.struct(
            description.alias("description"),
            F.lit(metric).alias("affected_metric"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            (F.lit(action) if isinstance(action, str) else action).alias("recommended_action"),
        )

    def one_place(c: Column) -> Column:
        return F.coalesce(round_to(c, 1), F.lit(0.0)).cast("string")

    rows = F.array(
        finding(
            F.concat(name, F.lit(" is the main cause with "), one_place(F.col("percentage_share") * 100), F.lit("% of cases")),
            "total_cases",
            F.when(F.col("is_confirmed"), F.lit("high")).otherwise(F.lit("medium")),
            F.concat(F.lit("Improve the process behind "), name),
        ),
        finding(
            F.concat(F.lit("Mean handling time "), one_place(F.col("_mean")), F.lit(" days, 90th percentile "), one_place(F.col("_p90")), F.lit(" days")),
            "avg_handling_days",
            "medium",
            "Shorten the workflow",
        ),
    )
    return row.select(F.inline(rows))
