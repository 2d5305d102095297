"""Ranks and quantiles of values that lie close together: no range holds more than its share."""

import random

import pytest
from pyspark.sql import functions as F

from casemill.functions import quantiles


@pytest.mark.parametrize("low,high", [(1_000_000, 1_010_000), (0, 0.012)])
def test_close_values_are_split(spark, monkeypatch, low, high):
    stored = []
    monkeypatch.setattr(quantiles, "durable", lambda df: stored.append(df) or df)
    rnd = random.Random(4)
    values = [rnd.uniform(low, high) for _ in range(8000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    quantiles.with_ranks(quantiles.value_counts(df, "v"))
    largest = stored[0].groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * len(values) / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ranks_of_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), ("a", 5.0), ("b", None)], "g string, v double")
    found = {(r.g, r.v): (r.before, r.total) for r in quantiles.with_ranks(quantiles.value_counts(df, "v", ["g"]), ["g"]).collect()}
    assert found == {("a", 1.0): (0, 3), ("a", 5.0): (2, 3)}
