"""Sinks: curated tables, quarantine, control rows, insert-only loads, reports, audit lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.sources import membership

JDBC_BATCH = 5_000
AUDIT_RESULTS = ("success", "failure")
AUDIT_REQUIRED = ("user_id", "action", "resource", "result")


def write_curated(df: DataFrame, path: str, by_month: bool = True) -> None:
    """Snappy Parquet, in one folder per opening month so that date filters prune folders.

    Rows are shuffled by month; AQE splits a month with most of the rows over many tasks and merges small ones, by
    the bytes that it finds.
    """
    out, writer = df, None
    if by_month:
        out = df.withColumn("opened_month", F.date_format("opened_on", "yyyy-MM")).hint("rebalance", "opened_month")
        writer = out.write.partitionBy("opened_month")
    (writer or out.write).mode("overwrite").option("compression", "snappy").parquet(path)


def write_table(df: DataFrame, target: str, mode: str = "append", jdbc: dict[str, str] | None = None) -> None:
    """Load a table: Parquet by default, a database in batches when connection options are given."""
    if jdbc:
        df.write.format("jdbc").options(**jdbc, dbtable=target, batchsize=str(JDBC_BATCH)).mode(mode).save()
    else:
        df.write.mode(mode).parquet(target)


def quarantine_rows(
    df: DataFrame, at: Column, rule: str | Column, reason: str | Column, reason_limit: int | None = None
) -> DataFrame:
    """(quarantine_timestamp, rule_id, reason, record_data) with the record as JSON.

    Reasons stay whole; ``reason_limit`` cuts them to so many characters.
    """

    def column(value: str | Column) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    extra = {"rule_id", "reason"}
    whole = column(reason)
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in extra])
    return df.select(
        at.cast("timestamp").alias("quarantine_timestamp"),
        column(rule).alias("rule_id"),
        whole.alias("reason") if reason_limit is None else F.substring(whole, 1, reason_limit).alias("reason"),
        F.to_json(record).alias("record_data"),
    )


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Append; later batches may bring more columns."""
    rows.write.mode("append").parquet(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def pending_files(files: DataFrame, control: DataFrame) -> DataFrame:
    """Files whose hash has no completed batch. The hash may be stored under its older name."""
    names = [c for c in ("file_hash", "source_file_hash") if c in control.columns]
    done = control.where(F.col("status") == "completed").select(F.coalesce(*names).alias("sha256")).distinct()
    return files.join(done, "sha256", "left_anti")


def upsert_batches(control: DataFrame, new: DataFrame) -> DataFrame:
    """Control rows with the new ones replacing those of the same batch; open batches have no end time."""
    ended = F.when(F.col("status") == "completed", F.col("completed_at"))
    fresh = new.withColumn("completed_at", ended)
    kept = control.join(new.select("batch_id"), "batch_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def _first_per_key(df: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    """One row per key chosen by an order over the other columns, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    return df.groupBy(*keys).agg(pick(F.struct(*others)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_batches(control: DataFrame, order: str = "started_at") -> DataFrame:
    """Latest row per batch of an append-only control log."""
    others = [c for c in control.columns if c not in ("batch_id", order)]
    ordered = control.select("batch_id", order, *others)
    return _first_per_key(ordered, ["batch_id"], F.max).select(*control.columns)


def missing_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not hold yet, the smallest row where a key repeats."""
    fresh = source.join(target.select(*keys), list(keys), "left_anti")
    return _first_per_key(fresh, list(keys), F.min)


def insert_missing(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], bits_per_key: int = membership.BITS_PER_KEY
) -> None:
    """Append rows with new keys; repeating the call adds nothing and earlier rows are untouched.

    Only files of the target whose membership filter may hold a key of ``source`` are read. Files get their
    filter after they are written; until then they are read.
    """
    held = membership.holding(source, path, source.schema, keys)
    fresh = _first_per_key(source, list(keys), F.min) if held is None else missing_rows(held, source, keys)
    fresh.write.mode("append").parquet(path)
    membership.index_files(spark, path, source.schema, keys, bits_per_key)


def export_report(report: DataFrame, columns: DataFrame, path: str) -> None:
    """Report as JSON lines, per-column figures as Parquet beside it."""
    report.write.mode("overwrite").json(f"{path}/report")
    columns.write.mode("overwrite").parquet(f"{path}/columns")


def audit_contract(df: DataFrame) -> Column:
    """Whether an audit row may be stored: required fields filled, result known."""
    ok = F.col("result").isin(*AUDIT_RESULTS)
    for name in AUDIT_REQUIRED:
        ok = ok & F.col(name).isNotNull() & (F.length(name) > 0)
    return F.coalesce(ok, F.lit(False))


def append_audit(df: DataFrame, path: str) -> None:
    """Append valid audit rows as JSON lines."""
    df.where(audit_contract(df)).write.mode("append").json(path)
