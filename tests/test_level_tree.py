"""The risk tree over levels: the splits of a tree over one-hot vectors, without a pass over all levels per row."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from casemill.operators import risk

FEATURES = ("a", "b", "c")


def tuples(spark, n, seed):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        a, b, c = rng.randrange(40), rng.randrange(6), rng.randrange(3)
        risky = 0.15 + 0.4 * (a == 7) + 0.3 * (b == 2 and c == 1) + 0.2 * (a == 11 and c != 0)
        rows.append((f"a{a}", f"b{b}", f"c{c}", int(rng.random() < risky), float(rng.randrange(1, 5))))
    return spark.createDataFrame(rows, "a string, b string, c string, label int, n double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_level_tree_equals_a_tree_over_vectors(spark, seed):
    df = tuples(spark, 3000, seed).withColumn("weight", F.col("n") * F.when(F.col("label") == 1, 2.3).otherwise(0.6))
    encode = risk.encoder(FEATURES).fit(df)
    rows = encode.transform(df)
    tree = risk.fit_level_tree(rows, FEATURES, [len(x) for x in encode.stages[0].labelsArray])
    known = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=risk.TREE_DEPTH).fit(rows)
    assert tree.featureImportances.toArray() == pytest.approx(known.featureImportances.toArray(), abs=1e-9)
    kept = ("prediction", "score", "label", "n")
    mine, theirs = (
        sorted((r["prediction"], round(r["score"], 9), r["label"], r["n"]) for r in found.select(*kept).collect())
        for found in (risk._score_tree(tree, rows), risk._score(known, rows))
    )
    assert mine == theirs


def test_level_tree_of_one_class_or_one_level_is_a_leaf(spark):
    for label in ("0", "cast(a = 'x' as int)"):
        df = spark.createDataFrame([("x", 1.0)] * 3, "a string, weight double").withColumn("label", F.expr(label))
        rows = risk.encoder(("a",)).fit(df).transform(df)
        tree = risk.fit_level_tree(rows, ("a",), [1])
        assert not tree.root.children and tree.featureImportances.toArray().tolist() == [0.0]
