"""Exact quantiles and ranks that hold no group in one task.

``F.percentile`` keeps one map of distinct values per group. That is the right tool for handling
times in whole days, where the map stays small however many rows there are. For a column of
arbitrary numbers rows become (value, count) pairs, the pairs are dealt by ranges of (group, value)
that Spark draws from the data, so values that lie close together are split like any others, and the
place of a value is the count of the ranges before its own plus the running count inside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from casemill.session import durable


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values (null included) with row counts: (by…, v, n). A hot group spreads over tasks."""
    return df.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def with_ranks(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add to (by…, v, n) the rows placed before each value and the group total: ``before``, ``total``.

    A value may come in several pairs, which then share its places.
    """
    dealt, places = _dealt(counts, by)
    return _placed(dealt, places).select(*counts.columns, "before", "total")


def _dealt(counts: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The pairs dealt by ranges, and (_k, _range, _rn, _before, _total): rows of a range, before it and of its group.

    The dealt pairs are stored with the number of their range, so that both passes see the same ranges.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    keyed = counts.where(F.col("v").isNotNull()).select("*", key.alias("_k"))
    dealt = durable(keyed.repartitionByRange(parts, "_k", "v").withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy("_k")
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        dealt.groupBy("_k", "_range").agg(F.sum("n").alias("_rn"))
        .select("_k", "_range", "_rn", F.coalesce(F.sum("_rn").over(earlier), F.lit(0)).alias("_before"), F.sum("_rn").over(group).alias("_total"))
    )
    return dealt, places


def _placed(dealt: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of the ranges that ``places`` holds, with the rows before each and the group total."""
    inside = Window.partitionBy("_k", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(places, ["_k", "_range"]).select(
        *[c for c in dealt.columns if c != "_range"],
        (F.col("_before") + F.sum("n").over(inside) - F.col("n")).alias("before"),
        F.col("_total").alias("total"),
    )


def quantiles_of_counts(
    counts: DataFrame, probs: dict[str, float], by: Sequence[str] = (), few_groups: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles per group of a (by…, v, n) table, one column per entry of ``probs``.

    Only ranges that hold a quantile are put in order: at most two for an entry and group. With ``few_groups`` they
    are broadcast, so the other pairs are not moved again.
    """
    dealt, places = _dealt(counts, by)
    at = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    ends = [side(at(p)) for p in probs.values() for side in (F.floor, F.ceil)]
    held = [(rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_rn")) for rank in ends]
    needed = places.where(reduce(lambda a, b: a | b, held))
    ranked = _placed(dealt, F.broadcast(needed) if few_groups else needed).select(
        "_k", "v", "before", "total", (F.col("before") + F.col("n")).alias("upto")
    )
    position = lambda p: (F.col("total") - 1) * F.lit(float(p))
    picks = [F.max("total").alias("total")]
    for name, p in probs.items():
        for side, rank in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            picks.append(F.min(F.when((rank >= F.col("before")) & (rank < F.col("upto")), F.col("v"))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy("_k").agg(*picks)
    columns = [F.col(f"_k.{c}").alias(c) for c in by]
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((lo + (hi - lo) * (position(p) - F.floor(position(p)))).alias(name))
    return picked.select(*columns)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of a column per group."""
    return quantiles_of_counts(value_counts(df, value, by), probs, by)
