import random

from pyspark.sql import functions as F

from casemill.llm import toxicity


def corpus(spark, n=600):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(500)}" for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        bad = rnd.random() < 0.25
        if bad:
            text.insert(rnd.randrange(len(text)), rnd.choice(("Vileword", "nastyterm")))
        rows.append((i, " ".join(text), 0.0))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id int, text string, score double"), spark.createDataFrame(labels, "doc_id int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    found = toxicity.scored(docs, labels, F.col("doc_id") % 5 != 0, features=512).join(labels, "doc_id")
    held = found.where("doc_id % 5 = 0")
    right = held.where((F.col("score") >= 0.5).cast("int") == F.col("toxic")).count()
    assert right >= 0.95 * held.count()


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(spark, 120)
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (
        sorted(map(tuple, toxicity.scored(docs, x, F.col("doc_id") % 5 != 0, features=64).collect())) for x in (labels, flipped)
    )
    assert one == other


def test_edges(spark):
    docs, labels = corpus(spark, 60)
    odd = spark.createDataFrame([(None, None, 0.0), (900, "", 0.0), (901, "x" * 300_000, 0.0), (5, "again", 0.0)], docs.schema)
    more = spark.createDataFrame([(None, 1), (5, None), (5, 1), (5555, 1)], labels.schema)
    found = toxicity.scored(docs.union(odd), labels.union(more), F.lit(True), features=64).collect()
    assert len(found) == 64 and all(0 <= r.score <= 1 for r in found)
    assert [r.score for r in toxicity.scored(docs, labels.limit(0), F.lit(True)).limit(2).collect()] == [0.5, 0.5]
    assert toxicity.scored(docs, labels.where("toxic = 1"), F.lit(True)).first().score == 1.0
    assert toxicity.scored(docs.limit(0), labels, F.lit(True)).count() == 0


def test_many_telling_words_each_keep_their_ratio(spark):
    """The n-grams of 300 common and 100 rarer telling words do not fit 8,192 features; the rarer ones count too."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    plain = [word() for _ in range(40)]
    telling = [(word(), 6 if i < 300 else 3) for i in range(400)]
    body = lambda: " ".join(rnd.choice(plain) for _ in range(12))
    rows = [(f"{body()} {w} {body()}", 1, True) for w, times in telling for _ in range(times)]
    rows += [(f"{body()} {body()}", 0, True) for _ in range(len(rows))]
    rows += [(f"{body()} {w} {body()}", 1, False) for w, times in telling if times == 3]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(rows)], "doc_id int, toxic int")
    first_held = sum(trains for _, _, trains in rows)
    found = toxicity.scored(docs, labels, F.col("doc_id") < first_held).where(F.col("doc_id") >= first_held)
    assert found.where("score >= 0.5").count() >= 95
