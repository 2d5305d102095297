import math
import random

import pytest
from pyspark.sql import functions as F

from casemill.llm import topk


def brute(rows, k):
    kept = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(math.floor(256 * x) for x in v)
        kept[i] = min(kept.get(i, w), w)
    width = max(map(len, kept.values()), default=0)
    kept = {i: w + (0,) * (width - len(w)) for i, w in kept.items()}
    out = []
    for q in kept:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(kept[q], w)), i) for i, w in kept.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(7, 3), (2048, 1024)])
def test_equals_brute_force(spark, shard, block):
    rnd = random.Random(shard)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(80)]
    rows += [(80 + i, [0.5] * 6) for i in range(15)] + [(100 + i, [rnd.choice((-1.0, 0.0, 1.0)) for _ in range(6)]) for i in range(30)]
    rows += [(None, [1.0] * 6), (140, None), (141, [float("nan")] * 6), (142, [1.0, None]), (145, []), (143, [float("inf")] * 6)]
    rows += [(150, [1.0, 2.0]), (3, rows[3][1]), (155, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = topk.top_k(df, F.col("vec_id") % 5 == 0, k=4, shard_rows=shard, block_queries=block)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    found = topk.top_k(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 256 * 512), (2, -256 * 256)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_queries_are_not_broadcast(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k=3, shard_rows=4, block_queries=4)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3)
    # The plan that ran, after AQE has seen the sizes: copies of the queries, one per shard, went through the driver.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("side_bytes", [1, 4000])
def test_sides_are_split(spark, monkeypatch, side_bytes):
    monkeypatch.setattr(topk, "SIDE_BYTES", side_bytes)
    monkeypatch.setattr(topk, "STRIPES", 2)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(120)]
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k=4, shard_rows=20, block_queries=6)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4)


def test_large_numbers_ties_and_few_vectors(spark):
    rnd = random.Random(3)
    for size in (1e3, 1e5, 5e6):
        # Scores up to 1e17: beyond what single or double precision holds.
        rows = [(i, [rnd.choice((-1, 1)) * rnd.uniform(0.5, 1) * size for _ in range(4)]) for i in range(60)]
        assert sorted(map(tuple, topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k=4, shard_rows=9).collect())) == brute(rows, 4)
    rows = [(i, [1.0, -1.0, 0.5]) for i in range(70)] + [(i, [0.0, 0.0]) for i in range(70, 90)] + [(i, [-1.0]) for i in range(90, 110)]
    for k in (3, 60, 500):
        found = topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k=k, shard_rows=16, block_queries=8)
        assert sorted(map(tuple, found.collect())) == brute(rows, k)
