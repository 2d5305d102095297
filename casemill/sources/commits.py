"""Visible batches of an output: staged folders, a manifest, and readers that follow it.

A run writes every part of its result to ``{output}/staged/{batch}/{part}``. Nothing of it is visible until
one entry of the manifest names the batch; writing that entry is the commit. A run that ends before leaves a
staged folder that no reader looks at, and its repetition stages a folder of its own. An entry carries the
key of what was read, so of two runs that have read the same source only the first counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST_SCHEMA = "batch_id string, source_key string, committed_at timestamp"


def staged(output: str, batch_id: str, part: str) -> str:
    return f"{output}/staged/{batch_id}/{part}"


def publish(spark: SparkSession, output: str, batch_id: str, source_key: str) -> None:
    """Make a staged batch visible: one entry in a file of its own, renamed into place when it is whole."""
    entry = spark.range(1).select(
        F.lit(batch_id).alias("batch_id"), F.lit(source_key).alias("source_key"), F.current_timestamp().alias("committed_at")
    )
    entry.coalesce(1).write.mode("append").json(f"{output}/manifest")


def discard(spark: SparkSession, output: str, batch_id: str) -> None:
    """Delete a staged folder; callers do so for batches that will not be published."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/staged/{batch_id}")
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def published(spark: SparkSession, output: str) -> DataFrame:
    """(source_key, batch_id, committed_at): the first entry of every source; an empty table before the first."""
    try:
        log = spark.read.schema(MANIFEST_SCHEMA).json(f"{output}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log = spark.createDataFrame([], MANIFEST_SCHEMA)
    first = F.min(F.struct("committed_at", "batch_id")).alias("_first")
    return log.groupBy("source_key").agg(first).select("source_key", "_first.batch_id", "_first.committed_at")


def batches(spark: SparkSession, output: str) -> list[str]:
    """Ids of the visible batches, oldest first (one per source)."""
    return [r["batch_id"] for r in sorted(published(spark, output).collect(), key=lambda r: (r["committed_at"], r["batch_id"]))]


def read_part(spark: SparkSession, output: str, part: str, fmt: str = "parquet", every: bool = False) -> DataFrame:
    """A part of the last visible batch, or of ``every`` visible one together."""
    visible = batches(spark, output)
    if not visible:
        raise ValueError(f"nothing is published in {output}")
    chosen = visible if every else visible[-1:]
    return spark.read.option("mergeSchema", "true").format(fmt).load([staged(output, b, part) for b in chosen])
