"""Ingestion run: files in, curated table and artifacts out, one control row per stage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.operators.contract import RULE_ID, check_contract
from casemill.operators.quality import quality_counters, quality_score, violations
from casemill.plans.report import quality_report
from casemill.schema import EARLIEST_OPENING
from casemill.session import durable, release
from casemill.sources import commits, readers, sinks

STAGES = ("ingest", "profile", "validate", "enrich", "serve")
CONTROL_SCHEMA = (
    "batch_id string, file_hash string, file_name string, status string, stages_completed string, records_read long, "
    "records_valid long, records_quarantined long, started_at timestamp, completed_at timestamp, "
    "processing_duration_seconds double, error string, sequence long"
)


@dataclass(frozen=True)
class IngestConfig:
    """Where a run reads and writes, and the parameters of its checks."""

    source: str
    output: str
    as_of: date
    fmt: str | None = None
    min_date: str = EARLIEST_OPENING
    enforce_unique: bool = True
    fingerprint: str = "content"
    catalogs: DataFrame | None = field(default=None, compare=False)


@dataclass
class _Batch:
    """Facts about one run, written to the control log after each stage."""

    batch_id: str
    file_hash: str | None
    file_name: str
    started_at: datetime
    stages: list[str] = field(default_factory=list)
    read: int | None = None
    valid: int | None = None
    quarantined: int | None = None
    writes: int = 0

    def record(self, spark: SparkSession, path: str, status: str, error: str | None = None) -> None:
        now = datetime.now(timezone.utc)
        done = now if status == "completed" else None
        seconds = (now - self.started_at).total_seconds()
        self.writes += 1
        row = (
            self.batch_id, self.file_hash, self.file_name, status, ",".join(self.stages), self.read, self.valid,
            self.quarantined, self.started_at, done, seconds, error, self.writes,
        )
        spark.createDataFrame([row], CONTROL_SCHEMA).coalesce(1).write.mode("append").json(path)


def read_control(spark: SparkSession, output: str) -> DataFrame:
    """Latest control row per batch; an empty table before the first run."""
    try:
        log = spark.read.schema(CONTROL_SCHEMA).json(f"{output}/control")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = spark.createDataFrame([], CONTROL_SCHEMA)
    return sinks.latest_batches(log, order="sequence")


def _batch_of(spark: SparkSession, config: IngestConfig) -> _Batch | None:
    """The batch of a source that is not visible and not recorded as completed; None if there is nothing to do."""
    digest = readers.source_digest(readers.source_files(spark, config.source, by=config.fingerprint))
    visible = commits.published(spark, config.output).select(F.col("source_key").alias("sha256"))
    unread = sinks.pending_files(digest, read_control(spark, config.output)).join(visible, "sha256", "left_anti")
    pending = unread.first()  # one row or none
    return pending and _Batch(_new_id(), pending["sha256"], pending["file_name"] or "", _now())


def _new_id() -> str:
    return uuid.uuid4().hex


def _now() -> datetime:
    return datetime.now(timezone.utc)


def run_pipeline(spark: SparkSession, config: IngestConfig) -> str:
    """Ingest, profile, validate, enrich, serve. Returns the status: completed, failed or skipped.

    The checked rows are written once to the shared folder; profile, split, score and both sinks read
    that copy instead of the source. All results are staged and become visible together, by one entry of the
    manifest, after the last stage: a run that fails anywhere leaves nothing that :func:`read_curated` or
    :func:`read_quarantined` show, and its repetition gives every row once.
    """
    control_path = f"{config.output}/control"
    batch = None
    try:
        batch = _batch_of(spark, config)
        if batch is None:
            return "skipped"
        into = partial(commits.staged, config.output, batch.batch_id)
        raw = readers.read_source(spark, config.source, config.fmt)
        batch.stages.append("ingest")
        batch.record(spark, control_path, "processing")

        normal = readers.normalize_cases(readers.standardize_columns(raw))
        checked = durable(check_contract(normal, config.min_date, config.enforce_unique))
        cases = checked.drop("failures")
        report = quality_report(cases, as_of=config.as_of, stored=True)
        sinks.export_report(report.summary, report.columns, into("quality"))
        batch.stages.append("profile")
        batch.record(spark, control_path, "processing")

        good, bad = F.col("failures") == "", F.col("failures") != ""
        counts = checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("valid")).first()
        batch.read, batch.valid, batch.quarantined = counts["n"], counts["valid"], counts["n"] - counts["valid"]
        rejected = checked.where(bad).withColumnRenamed("failures", "reason")
        sinks.write_quarantine(
            sinks.quarantine_rows(rejected, F.lit(batch.started_at), RULE_ID, F.col("reason")), into("quarantine")
        )
        batch.stages.append("validate")
        batch.record(spark, control_path, "processing")

        valid = checked.where(good).drop("failures")
        rules = (config.as_of, config.catalogs, config.min_date)
        counters = durable(quality_counters(valid, *rules))
        quality_score(valid, *rules, counters=counters).write.mode("overwrite").json(into("score"))
        violations(valid, *rules, counters=counters).write.mode("overwrite").json(into("violations"))
        batch.stages.append("enrich")
        batch.record(spark, control_path, "processing")

        sinks.write_curated(valid, into("curated"))
        commits.publish(spark, config.output, batch.batch_id, batch.file_hash)
        batch.stages.append("serve")
        batch.record(spark, control_path, "completed")
        release(checked, counters)
        return "completed"
    except Exception as error:  # noqa: BLE001  the failure itself is the result of the run
        batch = batch or _Batch(_new_id(), None, config.source.rstrip("/").rsplit("/", 1)[-1], _now())
        batch.record(spark, control_path, "failed", f"{type(error).__name__}: {error}")
        if batch.batch_id not in commits.batches(spark, config.output):
            commits.discard(spark, config.output, batch.batch_id)
        return "failed"


def read_curated(spark: SparkSession, output: str) -> DataFrame:
    """Valid rows of the last visible batch: each run replaces the curated table."""
    return commits.read_part(spark, output, "curated")


def read_quarantined(spark: SparkSession, output: str) -> DataFrame:
    """Quarantined rows of all visible batches."""
    return commits.read_part(spark, output, "quarantine", every=True)


def read_report(spark: SparkSession, output: str) -> DataFrame:
    """Quality report of the last visible batch."""
    return commits.read_part(spark, output, "quality/report", "json")
