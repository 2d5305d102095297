"""A corpus pipeline of the training-data operators: each stage reads what its predecessor kept.

Every stage but the last returns the columns of its input. Decisions are taken row by row: rows with a null
or a repeated id are documents of their own, after all others or in order of their other columns. Only rows
that repeat an id and are equal throughout are one document from the near-duplicate stage on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from casemill.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of an Arrow batch on its way to a Python worker, in stages that follow large shuffles.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send batches of about ``BATCH_BYTES``: a batch is in memory on both sides of the pipe.

    A batch still holds whole rows, so results do not depend on it. The session's own setting comes back.
    """
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def with_rows(docs: DataFrame) -> DataFrame:
    """(doc, row, text, source): the columns of ``docs`` in a struct, a number for each row, and what operators read.

    Numbers are in order of the id (null last) and of the other columns. Unique whole ids are these numbers.
    Otherwise the rows are sorted by ranges, numbered and stored; numbers depend on the data only, rows that are
    equal throughout are interchangeable.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    read = ["doc", "row", *[F.col(f"doc.{c}").alias(c) for c in ("text", "source") if c in kinds]]
    whole = kinds["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        return kept.withColumn("row", F.col("doc.doc_id").cast("long")).select(*read)
    order = ["doc_id", *[c for c in docs.columns if c != "doc_id" and "map<" not in kinds[c]]]
    placed = kept.orderBy(*[F.col(f"doc.`{c}`").asc_nulls_last() for c in order]).withColumn("at", F.monotonically_increasing_id())
    placed = durable(placed.withColumn("part", F.shiftright("at", 33)))
    before, offsets = 0, []
    # One row per part of the sort.
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["part"], before - (r["part"] << 33)))
        before += r["n"]
    starts = docs.sparkSession.createDataFrame(offsets, "part long, start long")
    return placed.join(F.broadcast(starts), "part").withColumn("row", F.col("at") + F.col("start")).select(*read)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays."""
    if docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        known = F.col("doc_id").isNotNull()
        docs = docs.where(~known).union(docs.where(known).dropDuplicates())
    rows = with_rows(docs)
    with small_batches(spark):
        links = jaccard_join.joined(rows, "row").where(F.col("doc_id") != F.col("component_id"))
        gone = durable(links.select(F.col("doc_id").alias("row")))
    return rows.join(gone, "row", "left_anti").select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what an earlier document, or an earlier part of the same one, already holds."""
    rows = with_rows(docs)
    with small_batches(spark):
        kept = durable(suffix_dedup.deduplicated(rows, "row", with_text=True))
    joined = rows.select("doc", "row").join(kept.select(F.col("doc_id").alias("row"), "kept_text"), "row", "left")
    text = F.coalesce("kept_text", "doc.text")
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it; what it does not take goes."""
    rows = with_rows(docs)
    copies = mixing.mixed(rows, "row").where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    taken = rows.select("doc", "row").join(durable(copies), "row")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]
#: Stages beyond the first cannot be expressed in SQL; tests/llm checks them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
