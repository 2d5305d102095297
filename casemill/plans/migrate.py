"""Record migration: clean, validate, load without duplicates, reconcile, report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.functions.numbers import round_to, share
from casemill.operators.contract import MIN_SUCCESS_PCT, clean, migration_failures, migration_valid, reconcile
from casemill.session import durable
from casemill.sources.sinks import insert_missing


def _keys(spark: SparkSession, target: str) -> DataFrame:
    """Ids that the target holds; none before the first load."""
    try:
        return spark.read.parquet(target).select(F.col("case_id").cast("long"))
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.range(0).select(F.col("id").alias("case_id"))


def migrate(
    spark: SparkSession, source: DataFrame, target: str, quarantine: str, batch_id: str,
    min_success: float = MIN_SUCCESS_PCT,
) -> DataFrame:
    """Run a migration into a Parquet table keyed by case id; one report row, counted from the target.

    ``loaded_count`` are the rows that this run added, ``present_count`` the valid source rows whose id the
    target holds afterwards, ``remaining_count`` those whose id it does not hold. Repeating a run loads
    nothing new and replaces the quarantine rows of its ``batch_id``; those of other migrations stay, so each
    migration needs an id of its own. A load error gives status ``aborted``
    with the counts of what the target really holds.
    """
    cleaned = durable(clean(source))
    valid, failures = migration_valid(cleaned), durable(migration_failures(cleaned))
    stamped = failures.withColumn("quarantine_timestamp", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
    before = _keys(spark, target).count()
    error: str | None = None
    try:
        insert_missing(spark, target, valid, ["case_id"])
    except Exception as problem:  # noqa: BLE001  reported in the row
        error = f"{type(problem).__name__}: {problem}"
    held = _keys(spark, target)
    loaded = held.count() - before
    present = valid.join(held.distinct(), "case_id", "left_semi").count()
    row = (
        reconcile(cleaned, valid, failures)
        .withColumn("remaining_count", F.col("loaded_count") - F.lit(present))
        .withColumn("loaded_count", F.lit(loaded).cast("long"))
        .withColumn("present_count", F.lit(present).cast("long"))
    )
    rate = F.coalesce(share(F.col("present_count"), F.col("source_count")), F.lit(0.0))
    status = F.when(rate >= min_success, F.lit("completed")).otherwise(F.lit("failed"))
    return row.select(
        "*",
        round_to(rate, 2).alias("success_rate"),
        (F.lit("aborted") if error else status).alias("status"),
        F.lit(error).cast("string").alias("error"),
    )
