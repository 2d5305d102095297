"""Running totals in a global order that keep no group of ties in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from casemill.session import durable


def with_running_total(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows up to this one in ``order``, which must be strict.

    Rows are dealt by ranges of the order and stored with the number of their range, so that both passes
    see the same ranges; a range adds what the ranges before it hold, one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.sum(value).alias("_s")).select(
        "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range.
    joined = dealt.withColumn("_inside", F.sum(value).over(inside)).join(F.broadcast(offsets), "_range")
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")
