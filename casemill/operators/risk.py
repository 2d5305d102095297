"""Risk of a long handling time: label, features, split, model, evaluation.

All features are categorical and known when a case opens, so rows with equal features and label are
interchangeable. The facts are folded once into (features, label, test?) tuples with counts; training
and evaluation use the counts as weights, which gives the same objective and the same metrics as the
rows would.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, Window, functions as F

from casemill.functions.numbers import round_to
from casemill.functions.quantiles import with_ranks
from casemill.session import durable, release

# Features known at opening, fields that leak the outcome, and model settings.
FEATURES = ("cause", "channel", "company", "case_type", "owner_unit", "marking")
LEAKAGE = ("closed_on", "outcome", "handling_days", "close_reason")
UNKNOWN = "desconocido"
TEST_SHARE = 0.25
SEED = 42
# Fixed value: iterations of the logistic regression.
MAX_ITERATIONS = 1000
IMBALANCED_BELOW = 0.20
MIN_AUC = 0.60
TREE_DEPTH = 4
DISCLAIMER = "Analytical demonstration — not a production-grade model"


def label_p90(df: DataFrame, value: str = "handling_days", p: float = 0.9) -> DataFrame:
    """Rows with a handling time, labelled 1 above the quantile; the quantile is added as ``threshold``."""
    timed = df.where(F.col(value).isNotNull())
    threshold = timed.agg(F.percentile(value, F.lit(p)).alias("threshold"))
    return timed.crossJoin(F.broadcast(threshold)).withColumn(  # exactly one row
        "label", (F.col(value) > F.col("threshold")).cast("int")
    )


def prepare_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Feature columns with nulls named, nothing else but ``label`` and ``is_test`` if present."""
    leaked = set(features) & set(LEAKAGE)
    if leaked:
        raise ValueError(f"fields not known when a case opens: {sorted(leaked)}")
    kept = [c for c in ("label", "is_test") if c in df.columns]
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in features], *kept)


def stratified_split(
    tuples: DataFrame, label: str = "label", test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Split (…, label, n) tuples into test and train counts: adds ``is_test``, ``n`` is divided.

    Tuples are put in a seeded hash order and every stretch of the running row count gives its share
    to the test set, so each label contributes exactly ``round(share x rows)`` rows and copies of a
    frequent tuple land on both sides. The running count goes over hash buckets first and then inside
    each bucket, so no label is ordered in one task.
    """
    columns = [c for c in tuples.columns if c != "n"]
    hashed = tuples.withColumn("_h", F.xxhash64(*columns, F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(4096)))
    buckets = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    places = (
        hashed.groupBy(label, "_b")
        .agg(F.sum("n").alias("_bn"))
        .select(label, "_b", (F.sum("_bn").over(buckets) - F.col("_bn")).alias("_start"))
    )
    inside = Window.partitionBy(label, "_b").orderBy("_h", *columns).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_start") + F.sum("n").over(inside)
    share = F.lit(test_share)
    counted = hashed.join(F.broadcast(places), [label, "_b"]).withColumn(  # at most 4,096 rows per label
        "_test", F.round(upto * share) - F.round((upto - F.col("n")) * share)
    )
    sides = F.array(
        F.struct(F.lit(True).alias("is_test"), F.col("_test").alias("n")),
        F.struct(F.lit(False).alias("is_test"), (F.col("n") - F.col("_test")).alias("n")),
    )
    return counted.select(*columns, F.inline(sides)).where(F.col("n") > 0)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per class, and whether the smaller class is below a fifth of all rows."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    totals = classes.agg(F.sum("count").alias("total"), F.min("count").alias("smallest"))
    return classes.crossJoin(F.broadcast(totals)).select(  # exactly one row
        label,
        "count",
        round_to(F.col("count") / F.col("total"), 4).alias("share"),
        (F.col("smallest") / F.col("total") < IMBALANCED_BELOW).alias("is_imbalanced"),
    ).orderBy(label)


def feature_tuples(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(features…, label, is_test, n): labelled, folded and split; written once to the shared folder."""
    # The split reads the folded rows twice.
    folded = durable(fold(prepare_features(label_p90(df), features), features))
    tuples = durable(stratified_split(folded))
    release(folded)
    return tuples


def fold(prepared: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Equal rows to one (features…, label, n)."""
    return prepared.groupBy(*features, "label").agg(F.count(F.lit(1)).cast("double").alias("n"))


def encoder(features: Sequence[str] = FEATURES) -> Pipeline:
    """Index and one-hot encode every level; sparse vectors keep a row as small as its features."""
    indexed, encoded = [f"{c}_index" for c in features], [f"{c}_vector" for c in features]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(features), outputCols=indexed, stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False),
            VectorAssembler(inputCols=encoded, outputCol="features"),
        ]
    )


def level_names(model: PipelineModel, features: Sequence[str] = FEATURES) -> list[str]:
    """Feature names in vector order."""
    return [f"{c}_{level}" for c, levels in zip(features, model.stages[0].labelsArray) for level in levels]


@dataclass
class _Node:
    """A node of a :class:`LevelTree`: weight per class, and the level that is split off if it is no leaf."""

    weights: tuple[float, float]
    gain: float = 0.0
    feature: str = ""
    level: int = 0
    place: int = 0
    children: tuple[_Node, ...] = field(default=())

    @property
    def prediction(self) -> int:
        return int(self.weights[1] > self.weights[0])

    @property
    def score(self) -> float:
        return self.weights[1] / sum(self.weights)

    def pruned(self) -> _Node:
        """The node without splits whose two leaves predict the same."""
        if not self.children:
            return self
        absent, present = (c.pruned() for c in self.children)
        if not absent.children and not present.children and absent.prediction == present.prediction:
            return _Node(self.weights)
        return _Node(self.weights, self.gain, self.feature, self.level, self.place, (absent, present))

    def choose(self, leaf) -> Column:
        """The value of ``leaf`` for the leaf that a row belongs to."""
        if not self.children:
            return F.lit(leaf(self))
        absent, present = (c.choose(leaf) for c in self.children)
        return F.when(F.col(f"{self.feature}_index") == self.level, present).otherwise(absent)


@dataclass(frozen=True)
class LevelTree:
    """A classification tree whose splits each separate one level of a feature from the others."""

    root: _Node
    size: int

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  named as in Spark's models
        """Share of the impurity removed by each level, in vector order."""
        found, waiting = [0.0] * self.size, [self.root]
        for node in waiting:  # grows while it is read
            if node.children:
                found[node.place] += node.gain * sum(node.weights)
                waiting.extend(node.children)
        total = sum(found)
        return DenseVector([v / total for v in found] if total else found)


def _gini(negative: Column, positive: Column) -> Column:
    total = negative + positive
    return 1.0 - (negative / total) * (negative / total) - (positive / total) * (positive / total)


def _best_splits(rows: DataFrame, features: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """One row per ``_node`` of weighted tuples: the level whose separation removes most Gini impurity, the first in
    vector order of equals.

    A level is one (node, feature, level) group of two sums, whatever the number of rows and levels.
    """
    levels = F.array(
        *[F.struct(F.lit(i).alias("_f"), F.col(f"{c}_index").alias("_level")) for i, c in enumerate(features)]
    )
    sums = [F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(F.lit(0.0))).alias(f"_in{k}") for k in (0, 1)]
    sums.append(F.count(F.lit(1)).alias("_rows"))
    present = rows.select("_node", "label", "weight", F.inline(levels)).groupBy("_node", "_f", "_level").agg(*sums)
    # Every row has one level of the first feature: its levels add up to the node.
    wholes = present.where(F.col("_f") == 0).groupBy("_node").agg(
        F.sum("_in0").alias("_all0"), F.sum("_in1").alias("_all1"), F.sum("_rows").alias("_all_rows")
    )
    in0, in1, all0, all1 = (F.col(c) for c in ("_in0", "_in1", "_all0", "_all1"))
    inside, total = in0 + in1, all0 + all1
    share = inside / total
    split = F.col("_rows") < F.col("_all_rows")
    gain = _gini(all0, all1) - (1.0 - share) * _gini(all0 - in0, all1 - in1) - share * _gini(in0, in1)
    start = F.element_at(F.array(*map(F.lit, offsets)), F.col("_f") + 1)
    place = (start + F.col("_level")).cast("int")
    # Equal gains differ by rounding: they are compared to fourteen places.
    best = F.max_by(F.struct("_f", "_level", place.alias("place"), "_gain", "_in0", "_in1"), F.struct(F.round("_gain", 14), -place))
    return (
        present.join(F.broadcast(wholes), "_node")  # one row per node
        .withColumn("_gain", F.when(split, gain).otherwise(F.lit(-1.0)))
        .groupBy("_node", "_all0", "_all1")
        .agg(best.alias("_best"))
        .select("_node", "_all0", "_all1", "_best.*")
    )


def fit_level_tree(weighted: DataFrame, features: Sequence[str], sizes: Sequence[int], depth: int = TREE_DEPTH) -> LevelTree:
    """Grow a tree over (``<feature>_index``…, label, weight) by Gini impurity, as a tree over the one-hot vectors.

    All levels compete in every node. A round is one aggregation by (node, feature, level), so a row costs its
    features and not the levels of all features; at most ``2 ** depth`` rows come to the driver.
    """
    offsets = [sum(sizes[:i]) for i in range(len(sizes))]
    root = _Node((0.0, 0.0))
    open_nodes = [root]
    for _ in range(depth):
        numbers = {id(node): i for i, node in enumerate(open_nodes)}
        placed = weighted.withColumn("_node", root.choose(lambda leaf: numbers.get(id(leaf), -1)))
        grown = []
        for r in _best_splits(placed.where(F.col("_node") >= 0), features, offsets).collect():
            node = open_nodes[r["_node"]]
            if node is root:
                node.weights = (r["_all0"], r["_all1"])
            if r["_gain"] > 1e-15:
                node.gain, node.feature, node.level, node.place = r["_gain"], features[r["_f"]], r["_level"], r["place"]
                inside = (r["_in0"], r["_in1"])
                node.children = tuple(_Node(w) for w in ((r["_all0"] - inside[0], r["_all1"] - inside[1]), inside))
                grown.extend(c for c in node.children if min(c.weights) > sum(c.weights) * 1e-12)
        open_nodes = grown
        if not open_nodes:
            break
    return LevelTree(root.pruned(), sum(sizes))


def _score_tree(tree: LevelTree, rows: DataFrame) -> DataFrame:
    return rows.select(
        "label",
        tree.root.choose(lambda leaf: leaf.prediction).alias("prediction"),
        tree.root.choose(lambda leaf: leaf.score).alias("score"),
        "n",
    )


@dataclass(frozen=True)
class RiskModel:
    """A trained model with what is needed to explain it."""

    kind: str
    encoder: PipelineModel
    classifier: object
    names: list[str]
    scored: DataFrame
    metrics: dict[str, float]
    limitations: tuple[str, ...]
    imbalanced: bool
    train_rows: int
    test_rows: int


def _weighted(train: DataFrame) -> tuple[DataFrame, float, bool]:
    """Training tuples with class weights, the sum of the weights, and whether classes are imbalanced."""
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if len(counts) < 2:
        raise ValueError("both classes are needed to train")
    imbalanced = min(counts.values()) / total < IMBALANCED_BELOW
    weight: Column = F.lit(1.0)
    if imbalanced:
        for label, n in counts.items():
            weight = F.when(F.col("label") == label, F.lit(total / (2.0 * n))).otherwise(weight)
    # Balanced weights add up to the number of rows, like unit weights do.
    return train.withColumn("weight", F.col("n") * weight), total, imbalanced


def _score(model, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).select(
        "label",
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
        "n",
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """One row of metrics from (label, prediction, score, n): confusion counts, precision, recall, F1, AUC."""

    def cell(label: int, prediction: int) -> Column:
        hit = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0.0)).cast("long")

    cells = scored.agg(
        cell(0, 0).alias("true_negative"),
        cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"),
        cell(1, 1).alias("true_positive"),
    )
    positive = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(F.lit(0.0)))
    negative = F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(F.lit(0.0)))
    by_score = scored.groupBy(F.col("score").alias("v")).agg(positive.alias("pos"), negative.alias("n"))
    # A positive outranks every negative below it and half of those with its own score.
    pairs = F.sum(F.col("pos") * (F.col("before") + F.col("n") / 2.0))
    auc = with_ranks(by_score).agg(
        (pairs / F.nullif(F.sum("pos") * F.sum("n"), F.lit(0.0))).alias("_auc")
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(round_to(part / F.nullif(whole, F.lit(0)), 4), F.lit(0.0))

    return cells.crossJoin(F.broadcast(auc)).select(  # exactly one row
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        F.coalesce(round_to(F.col("_auc"), 4), F.lit(0.5)).alias("roc_auc"),
        *cells.columns,
    )


def train_risk(df: DataFrame, features: Sequence[str] = FEATURES) -> RiskModel:
    """Logistic regression with unit regularisation; a shallow tree instead if its ranking is poor."""
    tuples = feature_tuples(df, features)
    encode = encoder(features).fit(tuples)
    levels = [F.col(f"{c}_index").cast("int").alias(f"{c}_index") for c in features]
    vectors = durable(encode.transform(tuples).select("features", "label", "is_test", "n", *levels))
    train, test = vectors.where(~F.col("is_test")), vectors.where(F.col("is_test"))
    weighted, total, imbalanced = _weighted(train)
    logistic = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        family="binomial",
        standardization=False,
        regParam=1.0 / total,
        elasticNetParam=0.0,
        maxIter=MAX_ITERATIONS,
        tol=1e-6,
    ).fit(weighted)
    kind, chosen = "logistic_regression", logistic
    scored = _score(logistic, test)
    metrics = evaluate(scored).first().asDict()
    limitations: list[str] = []
    if logistic.summary.totalIterations >= MAX_ITERATIONS:
        limitations.append(f"logistic regression stopped at its limit of {MAX_ITERATIONS} iterations")
    if metrics["roc_auc"] < MIN_AUC:
        limitations.append(f"logistic regression reaches a ROC-AUC of {metrics['roc_auc']}; tried a decision tree")
        tree = fit_level_tree(weighted, features, [len(levels) for levels in encode.stages[0].labelsArray])
        tree_scored = _score_tree(tree, test)
        tree_metrics = evaluate(tree_scored).first().asDict()
        if tree_metrics["roc_auc"] >= metrics["roc_auc"]:
            kind, chosen, scored, metrics = "decision_tree", tree, tree_scored, tree_metrics
        else:
            limitations.append(f"the decision tree reaches only {tree_metrics['roc_auc']}")
    if metrics["roc_auc"] < MIN_AUC:
        limitations.append(f"final ROC-AUC {metrics['roc_auc']} is below {MIN_AUC}; predictive power is limited")
    test_rows = sum(metrics[c] for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
    return RiskModel(
        kind, encode, chosen, level_names(encode, features), scored, metrics, tuple(limitations), imbalanced,
        int(total), int(test_rows),
    )


def feature_importance(model: RiskModel, spark) -> DataFrame:
    """(feature, importance) by absolute value; as many rows as the features have levels."""
    raw = model.classifier.coefficients if model.kind == "logistic_regression" else model.classifier.featureImportances
    rows = [(name, round(float(v), 6)) for name, v in zip(model.names, raw.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc(F.abs("importance")), "feature"
    )


REPORT_SCHEMA = (
    "model_type string, precision double, recall double, f1_score double, roc_auc double, true_negative long, "
    "false_positive long, false_negative long, true_positive long, train_rows long, test_rows long, "
    "is_imbalanced boolean, limitations string, disclaimer string"
)


def risk_report(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One-row result document; a placeholder row when the table cannot be trained on."""
    spark = df.sparkSession
    try:
        m = train_risk(df, features)
    except ValueError as error:
        row = ("logistic_regression", 0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, False, str(error), DISCLAIMER)
        return spark.createDataFrame([row], REPORT_SCHEMA)
    names = ("precision", "recall", "f1_score", "roc_auc", "true_negative", "false_positive", "false_negative", "true_positive")
    row = (m.kind, *[m.metrics[n] for n in names], m.train_rows, m.test_rows, m.imbalanced, "; ".join(m.limitations), DISCLAIMER)
    return spark.createDataFrame([row], REPORT_SCHEMA)


def report_problems(report: DataFrame) -> DataFrame:
    """Rows (field) whose value breaks the result contract: metrics in [0, 1], known model type."""
    checks = [F.when(~F.col(c).between(0.0, 1.0), F.lit(c)) for c in ("precision", "recall", "f1_score", "roc_auc")]
    checks.append(F.when(~F.col("model_type").isin("logistic_regression", "decision_tree"), F.lit("model_type")))
    return report.select(F.explode(F.array_compact(F.array(*checks))).alias("field"))
