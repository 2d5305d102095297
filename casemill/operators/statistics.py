"""Descriptive statistics, intervals and tests. Spark does counts and sums; one row per group is finished after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import round_to, share
from casemill.functions.quantiles import quantiles_of_counts, value_counts, with_ranks
from casemill.functions.special import (
    chi2_p_value,
    normal_p_value,
    normal_quantile,
    rank_score_sums,
    shapiro_result,
    t_critical,
)
from casemill.schema import IQR_FENCE, LOW_SAMPLE, MIN_GROUP, SIGNIFICANCE

_QUANTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95}


def _join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group rows; without groups the right side is exactly one row."""
    return left.join(right, list(by), how) if by else left.crossJoin(F.broadcast(right))


def _describe(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """All figures from one table of (group, value, count); facts are read and shuffled once."""
    counts = value_counts(df, value, by)
    present = F.col("v").isNotNull()
    weighted = F.when(present, F.col("v") * F.col("n"))
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("size"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.sum(weighted).alias("_sum"),
        F.max("v").alias("_max"),
        # Most frequent value, the smallest on ties.
        F.min(F.when(present, F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))).alias("_mode"),
    )
    quantiles = quantiles_of_counts(counts, _QUANTILES, by)
    centre = totals.select(*by, (F.col("_sum") / F.col("count")).alias("_mean"))
    iqr = F.col("q3") - F.col("q1")
    fences = _join_groups(quantiles, centre, by).select(
        *by,
        "_mean",
        iqr.alias("_iqr"),
        (F.col("q1") - IQR_FENCE * iqr).alias("_low"),
        (F.col("q3") + IQR_FENCE * iqr).alias("_high"),
    )
    outside = (F.col("_iqr") != 0) & ((F.col("v") < F.col("_low")) | (F.col("v") > F.col("_high")))
    gap = F.col("v") - F.col("_mean")
    spread = (
        _join_groups(counts.where(present), fences, by)
        .groupBy(*by)
        .agg(
            F.sum(gap * gap * F.col("n")).alias("_squares"),
            F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count"),
        )
    )
    if by:
        joined = totals.join(quantiles, list(by), "left").join(spread, list(by), "left")
    else:
        one = F.lit(True)
        joined = totals.join(quantiles, one, "left").join(spread, one, "left")  # one row each
    variance = F.col("_squares") / F.nullif(F.col("count") - 1, F.lit(0))

    def figure(c: Column) -> Column:
        return F.coalesce(round_to(c, 2), F.lit(0.0))

    return joined.select(
        *by,
        "size",
        "count",
        figure(F.col("_sum") / F.col("count")).alias("mean"),
        figure(F.col("q2")).alias("median"),
        round_to(F.col("_mode.v"), 2).alias("mode"),
        figure(variance).alias("variance"),
        figure(F.sqrt(variance)).alias("std"),
        figure(F.col("_max")).alias("max"),
        figure(F.col("q1")).alias("q1"),
        figure(F.col("q2")).alias("q2"),
        figure(F.col("q3")).alias("q3"),
        figure(F.col("p90")).alias("p90"),
        figure(F.col("p95")).alias("p95"),
        figure(round_to(F.col("q3"), 2) - round_to(F.col("q1"), 2)).alias("iqr"),
        F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"),
        figure(share(F.col("outlier_count"), F.col("count"))).alias("outlier_percentage"),
    )


def describe_numeric(df: DataFrame, value: str) -> DataFrame:
    """One row of descriptive figures; zeros (mode null) for a column without values."""
    return _describe(df, value, ()).drop("size")


def describe_by(df: DataFrame, value: str, group: str, min_group: int = MIN_GROUP) -> DataFrame:
    """The same per group. Group size counts rows whose value is null too."""
    rows = df.where(F.col(group).isNotNull())
    return _describe(rows, value, (group,)).where(F.col("size") >= min_group).drop("size").orderBy(group)


def iqr_outliers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, fences and strict outlier count; a zero quartile range never has outliers."""
    counts = value_counts(df, value, by).where(F.col("v").isNotNull())
    quartiles = quantiles_of_counts(counts, {"q1": 0.25, "q3": 0.75}, by).withColumn(
        "iqr", F.col("q3") - F.col("q1")
    )
    fences = quartiles.withColumn("lower_bound", F.col("q1") - IQR_FENCE * F.col("iqr")).withColumn(
        "upper_bound", F.col("q3") + IQR_FENCE * F.col("iqr")
    )
    outside = (F.col("iqr") != 0) & ((F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound")))
    figures = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]
    return (
        _join_groups(counts, fences, by)
        .groupBy(*by, *figures)
        .agg(
            F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count"),
            F.sum("n").alias("total_count"),
        )
        .withColumn(
            "outlier_percentage", round_to(share(F.col("outlier_count"), F.col("total_count")), 2)
        )
    )


def conditional_probability(df: DataFrame, condition: Column, group: str) -> DataFrame:
    """P(condition | group). Rows whose condition is null leave the denominator."""
    groups = df.groupBy(group).agg(
        F.count(F.when(condition, F.lit(1))).alias("hits"),
        F.count(condition).alias("sample_size"),
        F.count(F.lit(1)).alias("_rows"),
    )
    without_group = groups.agg(
        F.coalesce(F.sum(F.when(F.col(group).isNull(), F.col("_rows"))), F.lit(0)).alias("excluded_null_count")
    )
    return (
        groups.where(F.col(group).isNotNull())
        .crossJoin(F.broadcast(without_group))  # exactly one row
        .select(
            F.col(group).cast("string").alias("group_value"),
            F.coalesce(round_to(F.col("hits") / F.nullif(F.col("sample_size"), F.lit(0)), 4), F.lit(0.0)).alias(
                "probability"
            ),
            "sample_size",
            (F.col("sample_size") < LOW_SAMPLE).alias("is_low_confidence"),
            "excluded_null_count",
        )
        .orderBy("group_value")
    )


def wilson_interval(
    df: DataFrame, successes: str, total: str, confidence: float = 0.95, places: int | None = None
) -> DataFrame:
    """Add ``lower`` and ``upper`` score bounds to rows of successes and trials."""
    z = normal_quantile(1.0 - (1.0 - confidence) / 2.0)
    n, k = F.col(total).cast("double"), F.col(successes).cast("double")
    bad = F.raise_error(F.lit("wilson_interval needs 0 <= successes <= total and total > 0"))
    n = F.when((F.col(total) <= 0) | (F.col(successes) < 0) | (F.col(successes) > F.col(total)), bad).otherwise(n)
    p = k / n
    centre = p + z * z / (2.0 * n)
    margin = F.lit(z) * F.sqrt((p * (1.0 - p) + z * z / (4.0 * n)) / n)
    scale = 1.0 + z * z / n
    lower = F.greatest(F.lit(0.0), (centre - margin) / scale)
    upper = F.least(F.lit(1.0), (centre + margin) / scale)
    if places is not None:
        lower, upper = round_to(lower, places), round_to(upper, places)
    return df.withColumn("lower", lower).withColumn("upper", upper)


def chi_square_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of the independence test, one row.

    Empty cells need no rows: the sum of (O - E)^2 / E over the whole grid equals the sum of
    O^2 / E over the filled cells minus n, so the grid is never built.
    """
    cells = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    columns = cells.groupBy(b).agg(F.sum("o").alias("c"))
    row_margin = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(1.0 / F.col("r")).alias("inv_r"), F.sum("r").alias("n"))
    column_margin = columns.agg(F.count(F.lit(1)).alias("n_columns"), F.sum(1.0 / F.col("c")).alias("inv_c"))
    sums = (
        cells.join(rows, a)
        .join(columns, b)
        .agg(
            F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("q"),
            F.max(F.struct(F.col("o"), F.col("r"), F.col("c"))).alias("any"),
        )
    )
    one = sums.crossJoin(F.broadcast(row_margin)).crossJoin(F.broadcast(column_margin))  # one row each
    n = F.col("n").cast("double")
    dof = (F.col("n_rows") - 1) * (F.col("n_columns") - 1)
    plain = n * F.col("q") - n
    # With one degree of freedom every cell is off by the same amount, reduced by at most one half.
    gap = F.abs(F.col("any.o") - F.col("any.r").cast("double") * F.col("any.c") / n)
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) * n * F.col("inv_r") * F.col("inv_c")
    value = F.when(dof == 0, F.lit(0.0)).when(dof == 1, corrected).otherwise(plain)
    return one.select(value.alias("statistic"), dof.alias("degrees_of_freedom"), F.col("n").alias("sample_size"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test of two categorical columns, with continuity correction on 2 x 2 tables."""
    raw = chi_square_statistic(df, a, b)
    p = round_to(chi2_p_value(F.col("statistic"), F.col("degrees_of_freedom")), 4)
    return raw.select(
        F.lit("chi_square").alias("test_name"),
        round_to(F.col("statistic"), 4).alias("statistic"),
        p.alias("p_value"),
        "degrees_of_freedom",
    ).withColumn("is_significant", F.col("p_value") < SIGNIFICANCE)


def two_proportion_counts(df: DataFrame, group: str, first: str, second: str, condition: Column) -> DataFrame:
    """One row with sample sizes and hit counts of two groups."""
    aggregates = []
    for i, value in ((1, first), (2, second)):
        member = F.col(group) == value
        aggregates.append(F.count(F.when(member, condition)).alias(f"n{i}"))
        aggregates.append(F.count(F.when(member & condition, F.lit(1))).alias(f"k{i}"))
    return df.where(F.col(group).isin(first, second)).agg(*aggregates)


def two_proportion_z(df: DataFrame, group: str, first: str, second: str, condition: Column) -> DataFrame:
    """Pooled two-sided z-test of the proportions of two groups."""
    counts = two_proportion_counts(df, group, first, second, condition).where((F.col("n1") > 0) & (F.col("n2") > 0))
    p1, p2 = F.col("k1") / F.col("n1"), F.col("k2") / F.col("n2")
    pool = (F.col("k1") + F.col("k2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(pool * (1.0 - pool) * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    z = F.coalesce((p1 - p2) / F.nullif(se, F.lit(0.0)), F.lit(0.0))
    return (
        counts.withColumn("_z", z)
        .select(
            F.lit("two_proportion_z").alias("test_name"),
            round_to(F.col("_z"), 4).alias("statistic"),
            round_to(normal_p_value(F.col("_z")), 4).alias("p_value"),
            "n1",
            "n2",
        )
        .withColumn("is_significant", F.col("p_value") < SIGNIFICANCE)
    )


def _mean_parts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("sample_size"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std")
    )


def _mean_ci(parts: DataFrame, by: Sequence[str], confidence: float, min_group: int) -> DataFrame:
    big = parts.where(F.col("sample_size") >= min_group).withColumn(
        "_se", F.col("_std") / F.sqrt(F.col("sample_size"))
    )
    with_t = big.withColumn("_margin", t_critical(confidence, F.col("sample_size") - 1) * F.col("_se"))
    return with_t.select(
        *by,
        round_to(F.col("_mean"), 2).alias("mean"),
        round_to(F.col("_mean") - F.col("_margin"), 2).alias("lower"),
        round_to(F.col("_mean") + F.col("_margin"), 2).alias("upper"),
        F.lit(confidence).alias("confidence_level"),
        round_to(F.col("_se"), 4).alias("std_error"),
        "sample_size",
    )


def mean_ci(df: DataFrame, value: str, confidence: float = 0.95, min_group: int = MIN_GROUP) -> DataFrame:
    """Mean with its t interval; no row below the privacy minimum."""
    return _mean_ci(_mean_parts(df, value, ()), (), confidence, min_group)


def mean_ci_by(
    df: DataFrame, value: str, group: str, confidence: float = 0.95, min_group: int = MIN_GROUP
) -> DataFrame:
    rows = df.where(F.col(group).isNotNull())
    return _mean_ci(_mean_parts(rows, value, (group,)), (group,), confidence, min_group).orderBy(group)


def _shapiro(df: DataFrame, value: str, by: Sequence[str], min_group: int) -> DataFrame:
    """Shapiro-Wilk W from distinct values with their rank ranges.

    The weights depend on ranks only, so equal values need one row whatever their number: a value
    with ``n`` copies takes the ranks ``before + 1 … before + n``. W is a ratio of sums over those
    rows; no group is collected, and every value counts.
    """
    ranked = with_ranks(value_counts(df, value, by), by).where(F.col("total") >= min_group)
    first, last = F.col("before") + 1, F.col("before") + F.col("n")
    v, n = F.col("v"), F.col("n")

    def at(rank: Column) -> Column:
        return F.sum(F.when((first <= rank) & (rank <= last), v))

    sums = (
        ranked.withColumn("_s", rank_score_sums(first, last, F.col("total")))
        .groupBy(*by)
        .agg(
            F.max("total").alias("sample_size"),
            (F.sum(v * n) / F.sum("n")).alias("_mean"),
            F.sum("_s.squares").alias("_mm"),
            F.sum(v * F.col("_s.linear")).alias("_xm"),
            (at(F.col("total")) - at(F.lit(1))).alias("_ends"),
            (at(F.col("total") - 1) - at(F.lit(2))).alias("_next_ends"),
        )
    )
    gap = v - F.col("_mean")
    spread = (
        _join_groups(ranked, sums.select(*by, "_mean"), by).groupBy(*by).agg(F.sum(gap * gap * n).alias("_ss"))
    )
    result = shapiro_result(
        F.col("sample_size"), F.col("_mm"), F.col("_xm"), F.col("_ends"), F.col("_next_ends"), F.col("_ss")
    )
    return (
        _join_groups(sums, spread, by)
        .where(F.col("sample_size").isNotNull())
        .withColumn("_r", result)
        .select(
            *by,
            F.lit("shapiro_wilk").alias("test_name"),
            round_to(F.col("_r.w"), 4).alias("statistic"),
            round_to(F.col("_r.p"), 4).alias("p_value"),
            "sample_size",
        )
        .withColumn("is_normal", F.col("p_value") >= SIGNIFICANCE)
    )


def shapiro_wilk(df: DataFrame, value: str, min_group: int = MIN_GROUP) -> DataFrame:
    """Normality test of a column; no row below the privacy minimum."""
    return _shapiro(df, value, (), min_group)


def shapiro_by(df: DataFrame, value: str, group: str, min_group: int = MIN_GROUP) -> DataFrame:
    return _shapiro(df.where(F.col(group).isNotNull()), value, (group,), min_group).orderBy(group)
