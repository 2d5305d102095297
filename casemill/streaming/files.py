"""File ingestion as a stream: every file once, valid rows to the curated table, the rest to quarantine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from casemill.operators.contract import RULE_ID, check_contract, split_contract
from casemill.schema import EARLIEST_OPENING
from casemill.sources import membership
from casemill.sources.readers import normalize_cases
from casemill.sources.sinks import quarantine_rows


def _earlier_ids(valid: DataFrame, curated: str, number: int) -> DataFrame | None:
    """Ids of the curated table, from other micro-batches than this one or later, that may be among those of
    ``valid``; None if no file can hold one."""
    spark = valid.sparkSession
    batch_of = re.compile(r"/batch=(\d+)/")
    files = [f for f in membership.stored_files(spark, curated) if int(batch_of.search(f).group(1)) < number]
    files = membership.overlapping_files(valid, curated, valid.schema, ["case_id"], files)
    return membership.holding(valid, curated, valid.schema, ["case_id"], files) if files else None


def ingest_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    curated: str,
    quarantine: str,
    checkpoint: str,
    fmt: str = "json",
    min_date: str = EARLIEST_OPENING,
    max_files: int = 1000,
    enforce_unique: bool = True,
) -> StreamingQuery:
    """Start a bounded run over the files that have arrived and not been read.

    The checkpoint remembers the files. Each micro-batch writes its own folder and overwrites it when
    it is repeated after a failure, so no row is written twice. With ``enforce_unique`` ids that repeat inside
    a micro-batch, or that an earlier one has brought to the curated table, are quarantined; of the table only files
    whose membership filter may hold an id of the micro-batch are read.
    """

    def load(batch: DataFrame, number: int) -> None:
        stamped = F.current_timestamp()
        # Both outputs and the search for earlier ids read one check of the batch.
        checked = check_contract(normalize_cases(batch), min_date, enforce_unique).persist()
        valid, bad = split_contract(checked)
        present = _earlier_ids(valid, curated, number) if enforce_unique else None
        if present is not None:
            again = valid.join(present, "case_id", "left_semi").select(
                *valid.columns, F.lit(RULE_ID).alias("rule_id"), F.lit("case_id: not unique").alias("reason")
            )
            valid, bad = valid.join(present, "case_id", "left_anti").select(*valid.columns), bad.unionByName(again)
        valid.write.mode("overwrite").parquet(f"{curated}/batch={number}")
        if enforce_unique:
            membership.index_files(batch.sparkSession, curated, valid.schema, ["case_id"])
        quarantine_rows(bad, stamped, RULE_ID, F.col("reason")).write.mode("overwrite").parquet(
            f"{quarantine}/batch={number}"
        )
        checked.unpersist()

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", str(max_files)).load(source)
    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, then read what it wrote."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run an updating aggregation over everything available; the latest row per key.

    Every micro-batch writes the changed rows to its own folder, overwritten when it is repeated, so
    windows that are still open are visible too.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    changes = stream.sparkSession.read.parquet(path)
    values = [c for c in stream.columns if c not in keys]
    latest = F.max(F.struct(F.col("batch"), *values)).alias("_last")
    return changes.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])
