"""Running sums that keep no group in one task.

Rows are ordered by a key that is spread evenly over a known range, such as a hash. About sqrt(rows) bins
of that range are summed first; a row's running sum is the sum of the bins before its own, and the sum
inside its bin. No task holds more than a bin of a group, or one row per bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY_BITS = 60


def shuffle_key(*columns: Column) -> Column:
    """An even, repeatable key in [0, 2**60) from the md5 of the columns as text; nulls are empty."""
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def with_running_sum(
    rows: DataFrame, group: str, key: str, value: str, out: str, ties: Sequence[str] = (), n_rows: int | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` up to this one, in order of ``key``.

    ``key`` is a :func:`shuffle_key`. Rows that are equal in ``key`` and ``ties`` follow in any order. A
    null group is a group.
    """
    n_rows = rows.count() if n_rows is None else n_rows
    bins = max(1, int(n_rows**0.5))
    width = -(-(1 << KEY_BITS) // bins)
    binned = rows.withColumn("_bin", F.expr(f"{key} div {width}"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(F.col(group).alias("_g"), F.col("_bin").alias("_b"))
        .agg(F.sum(value).alias("_s"))
        .select("_g", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(group, "_bin").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        binned.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bin") == F.col("_b")))
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_g", "_b", "_bin", "_before", "_inside")
    )
