"""Streaming jobs and multi-stage runs."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from casemill.plans import ingest, migrate as migration, report
from casemill.schema import CASE_COLUMNS
from casemill.session import durable_dir
from casemill.sources import readers, sinks
from casemill.streaming import events as streams, files
from casemill.workload import operations, sources
from casemill.workload.quality import COUNTERS, DIM, SCORE
from casemill.workload.registry import query, rnd
from casemill.workload.tables import CASES, cases, table, with_cases


def _folder(spark, name: str) -> str:
    return f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


FILES_PER_ARRIVAL = 2


def _as_stream(spark, df, order: str):
    """The rows as files that arrive in time order, read back as a stream of one arrival per micro-batch."""
    path = _folder(spark, "arrivals")
    at = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("cuts")).first()["cuts"]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        arrived = df if low is None else df.where(at > low)
        arrived = arrived if high is None else arrived.where(at <= high)
        arrived.repartition(FILES_PER_ARRIVAL).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", str(FILES_PER_ARRIVAL)).parquet(path)


def _run(spark, stream):
    return files.run_to_table(stream, _folder(spark, "out"), _folder(spark, "checkpoint"))


@query("str01_throttle")
def throttle(spark, sf):
    log = operations._send_log(spark, sf).select(F.col("sender").cast("long").alias("sender"), "send_id", "sent_at")
    return _run(spark, streams.throttle_stream(_as_stream(spark, log, "sent_at")))


@query(
    "str02_request_state",
    f"SELECT request_id, attempt_id, code, reason, state, version FROM ({operations._replay_sql()})",
)
def request_state(spark, sf):
    return _run(spark, streams.request_state_stream(_as_stream(spark, operations._transition_log(spark, sf), "attempted_at")))


def _event_stream(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return _as_stream(spark, events, "ts")


def _updates(spark, stream):
    keys = ["period_start", "period_end"]
    return files.run_updates(stream, keys, _folder(spark, "out"), _folder(spark, "checkpoint"))


@query(
    "str04_daily_volume",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS period_end,
    count(*) AS count FROM events GROUP BY 1""",
)
def daily_volume(spark, sf):
    return _updates(spark, streams.volume_stream(_event_stream(spark, sf)))


@query(
    "str04_sliding_volume",
    """SELECT period_start, period_start + INTERVAL 1 DAY AS period_end, count(*) AS count FROM (
      SELECT time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * k) AS period_start FROM events, (VALUES (0), (1)) v(k))
    GROUP BY 1""",
)
def sliding_volume(spark, sf):
    return _updates(spark, streams.volume_stream(_event_stream(spark, sf), slide="12 hours"))


@query("str04_sessions")
def sessions(spark, sf):
    return _run(spark, streams.session_stream(_event_stream(spark, sf)))


@query(
    "str03_ingest_files",
    f"""WITH {sources.RAW}, n AS (SELECT CAST(id_pqr AS BIGINT) AS case_id, {sources._STATUS_SQL} AS status, {sources._DATE_SQL} AS opened_on FROM raw)
    SELECT status, count(*) FILTER (WHERE opened_on IS NOT NULL) AS valid, count(*) FILTER (WHERE opened_on IS NULL) AS quarantined FROM n GROUP BY status""",
)
def ingest_files(spark, sf):
    raw = sources._raw(spark, sf).withColumns(
        {"causa": F.lit("a"), "canal_atencion": F.lit("b"), "empresa": F.lit("c"), "tipo_pqr": F.lit("queja")}
    )
    # An id of its own for every row: the loader refuses repeated ones.
    raw = raw.withColumn("id_pqr", F.monotonically_increasing_id().cast(raw.schema["id_pqr"].dataType))
    arrived, curated, bad = (_folder(spark, n) for n in ("json", "curated", "quarantine"))
    raw.write.json(arrived)
    files.ingest_files(
        spark, arrived, raw.schema, curated, bad, _folder(spark, "checkpoint"), min_date="2017-01-01", max_files=2
    ).awaitTermination()
    kept = spark.read.parquet(curated).select("status", F.lit(1).alias("valid"), F.lit(0).alias("quarantined"))
    lost = spark.read.parquet(bad).select(
        F.get_json_object("record_data", "$.status").alias("status"), F.lit(0).alias("valid"), F.lit(1).alias("quarantined")
    )
    return kept.unionByName(lost).groupBy("status").agg(
        F.sum("valid").alias("valid"), F.sum("quarantined").alias("quarantined")
    )


# Every seventh line of an order repeats the id of the sixth.
OWN_ID = "l_orderkey * 8 + CASE WHEN l_linenumber = 7 THEN 6 ELSE l_linenumber END"


@query(
    "src22_ingest_run",
    f"""WITH {CASES.strip().replace("SELECT l_orderkey AS case_id", f"SELECT {OWN_ID} AS case_id")}, checked AS (
      SELECT *, concat_ws('; ', CASE WHEN opened_on < DATE '1996-06-01' THEN 'opened_on: before 1996-06-01' END,
        CASE WHEN count(*) OVER (PARTITION BY case_id) > 1 THEN 'case_id: not unique' END) AS reason FROM cases)
    SELECT CASE WHEN reason = '' THEN 'curated' ELSE 'quarantined' END AS part, CAST(case_id AS BIGINT) AS case_id,
      CAST(opened_on AS VARCHAR) AS opened_on, status, cause, company, case_type, CAST(handling_days AS DOUBLE) AS handling_days, reason,
      'completed' AS status_of_run, 'ingest,profile,validate,enrich,serve' AS stages_completed, 'completed' AS first_run, 'skipped' AS second_run
    FROM checked""",
)
def ingest_run(spark, sf):
    source, output = _folder(spark, "source") + ".parquet", _folder(spark, "run")
    own = F.expr(OWN_ID.replace("l_orderkey", "case_id").replace("l_linenumber", "line"))
    lines = cases(spark, sf, *CASE_COLUMNS, extra={"line": F.col("l_linenumber")})
    lines.withColumn("case_id", own).drop("line").write.parquet(source)
    config = ingest.IngestConfig(source, output, date(2001, 12, 31), min_date="1996-06-01")
    first, second = ingest.run_pipeline(spark, config), ingest.run_pipeline(spark, config)
    names = ["case_id", "opened_on", "status", "cause", "company", "case_type", "handling_days"]
    kept = ingest.read_curated(spark, output).select(
        F.lit("curated").alias("part"), *[F.col(c).cast("string") if c == "opened_on" else F.col(c) for c in names], F.lit("").alias("reason")
    )
    record = "case_id long, opened_on string, status string, cause string, company string, case_type string, handling_days double"
    lost = ingest.read_quarantined(spark, output).select(F.from_json("record_data", record).alias("r"), "reason").select(
        F.lit("quarantined").alias("part"), *[F.col(f"r.{c}") for c in names], "reason"
    )
    control = ingest.read_control(spark, output).select(
        F.col("status").alias("status_of_run"), "stages_completed", F.lit(first).alias("first_run"), F.lit(second).alias("second_run")
    )
    return kept.unionByName(lost).crossJoin(F.broadcast(control))  # one batch


@query(
    "val06_migrate",
    f"""WITH {sources.DIRTY} SELECT *, source_count = present_count + quarantined_count AS match,
      {rnd("present_count * 100e0 / source_count", 2)} AS success_rate,
      CASE WHEN present_count * 100e0 / source_count >= 95 THEN 'completed' ELSE 'failed' END AS status, CAST(NULL AS VARCHAR) AS error FROM (SELECT
      (SELECT count(*) FROM dirty) AS source_count, (SELECT count(DISTINCT case_id) FROM good) AS loaded_count,
      (SELECT count(*) FROM good) AS present_count, CAST(0 AS BIGINT) AS remaining_count,
      (SELECT count(*) FROM failed) AS quarantined_count, (SELECT count(DISTINCT record_id) FROM failed) AS failed_records)""",
)
def migrate(spark, sf):
    return migration.migrate(spark, sources._dirty(spark, sf), _folder(spark, "target"), _folder(spark, "quarantine"), "dirty")


@query(
    "prf09_quality_report",
    with_cases(
        f"""SELECT DATE '2001-12-31' AS as_of, '1.0' AS schema_version, *, {SCORE} AS composite_score, '' AS errors FROM (SELECT
          n AS total_record_count, CAST(13 AS BIGINT) AS total_column_count, {DIM["completeness"]} AS overall_completeness_pct,
          100e0 AS overall_validity_pct, {rnd("(n - ids) * 100e0 / n", 2)} AS duplication_rate, {DIM["completeness"]} AS completeness,
          100e0 AS validity, 100e0 AS consistency, 100e0 - {rnd("(n - ids) * 100e0 / n", 2)} AS uniqueness, 100e0 AS timeliness,
          100e0 AS referential_integrity FROM k)""",
        COUNTERS,
    ),
)
def quality_report(spark, sf):
    return report.quality_report(cases(spark, sf), as_of=date(2001, 12, 31)).summary


@query(
    "src18_export_report",
    with_cases("SELECT count(*) AS total_record_count, CAST(13 AS BIGINT) AS profiled_columns FROM cases"),
)
def export_report(spark, sf):
    found = report.quality_report(cases(spark, sf), as_of=date(2001, 12, 31))
    path = _folder(spark, "report")
    sinks.export_report(found.summary, found.columns, path)
    columns = spark.read.parquet(f"{path}/columns").agg(F.count(F.lit(1)).alias("profiled_columns"))
    return spark.read.json(f"{path}/report").select("total_record_count").crossJoin(columns)  # one row each


@query("src19_read_audit", "SELECT event_id, event_type AS action FROM events")
def read_audit(spark, sf):
    path = _folder(spark, "lines")
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("action")))
    events = table(spark, sf, "events")
    # Every tenth line is also written a second time, cut in half.
    broken = events.where("event_id % 10 = 0").select(F.expr("substring(to_json(struct(event_id, event_type)), 1, 9)").alias("value"))
    events.select(line.alias("value")).unionByName(broken).write.text(path)
    return readers.read_audit(spark, path).select("event_id", "action")
