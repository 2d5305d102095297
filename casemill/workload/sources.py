"""Ingestion, sinks, masking, contract validation and migration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.functions.numbers import to_double
from casemill.functions.text import normalize_status, spreadsheet_date
from casemill.operators import contract, kpis, privacy
from casemill.session import durable_dir
from casemill.sources import readers, sinks
from casemill.workload.registry import query, rnd
from casemill.workload.tables import cases, table, with_cases


def _scratch(spark, name: str) -> str:
    return f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src02_csv_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    path = _scratch(spark, "nation") + ".csv"
    table(spark, sf, "nation").write.option("header", "true").csv(path)
    return readers.read_source(spark, path)


@query(
    "src02_orc_round_trip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def orc_round_trip(spark, sf):
    path = _scratch(spark, "orders") + ".orc"
    table(spark, sf, "orders").drop("o_orderdate").write.orc(path)
    return readers.read_source(spark, path)


@query("src02_json_round_trip", "SELECT user_id, event_id, value, event_type FROM events")
def json_round_trip(spark, sf):
    path = _scratch(spark, "events") + ".json"
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    events.write.json(path)
    return readers.read_source(spark, path, schema=events.schema)


@query(
    "src03_source_metadata",
    """SELECT 'orders' AS part, count(*) AS records, CAST(6 AS BIGINT) AS columns, CAST(1 AS BIGINT) AS files FROM orders
    UNION ALL SELECT 'events', count(*), CAST(6 AS BIGINT), CAST(1 AS BIGINT) FROM events""",
)
def source_metadata(spark, sf):
    parts = {n: f"{sf}/{n}.parquet" for n in ("orders", "events")}
    return readers.source_metadata(spark, parts).select("part", "records", "columns", "files")


@query("src03_source_hashes")
def source_hashes(spark, sf):
    return readers.source_files(spark, sf, "*.parquet").select("file_name", "bytes", "sha256")


@query("src04_validate_source")
def validate_source(spark, sf):
    report = readers.validate_source(spark, f"{sf}/orders.parquet")
    return report.agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings")
    )


@query(
    "src05_union_parts",
    """SELECT CAST(o_orderkey AS DOUBLE) AS key, o_orderstatus AS code, o_totalprice AS amount, CAST(NULL AS BIGINT) AS size FROM orders
    UNION ALL SELECT CAST(p_partkey AS DOUBLE), p_brand, p_retailprice, p_size FROM part
    UNION ALL SELECT l_quantity, CAST(l_linenumber AS VARCHAR), NULL, l_suppkey FROM lineitem""",
)
def union_parts(spark, sf):
    a = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("amount")
    )
    b = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_brand").alias("code"), F.col("p_retailprice").alias("amount"),
        F.col("p_size").alias("size"),
    )
    c = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("key"), F.col("l_linenumber").alias("code"), F.col("l_suppkey").alias("size")
    )
    return readers.union_parts([a, b, c]).select("key", "code", "amount", "size")


@query(
    "src06_standardize_columns",
    """SELECT c_custkey AS id_cliente, c_name AS n_mero_2, c_nationkey AS column_2, c_acctbal AS saldo_total,
    c_mktsegment AS saldo_total_2 FROM customer""",
)
def standardize_columns(spark, sf):
    messy = table(spark, sf, "customer").toDF("  ID Cliente ", "Número #2", "***", "Saldo--Total", "saldo total")
    return readers.standardize_columns(messy)


@query(
    "src07_verify_integrity",
    """SELECT o_orderstatus AS part, count(*) AS source_records, count(*) FILTER (WHERE o_totalprice > 1000) AS output_records,
      count(*) - count(*) FILTER (WHERE o_totalprice > 1000) AS record_diff, CAST(1 AS BIGINT) AS column_diff, false AS is_valid
    FROM orders GROUP BY 1""",
)
def verify_integrity(spark, sf):
    source = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "part")
    return readers.verify_integrity(source, source.where("o_totalprice > 1000").drop("o_custkey"))


RAW = """raw AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS id_pqr,
    CASE l_linenumber % 4 WHEN 0 THEN '  ' || CAST(l_quantity AS VARCHAR) WHEN 1 THEN l_quantity || 'd' WHEN 2 THEN 'NaN'
      ELSE CAST(l_quantity AS VARCHAR) END AS tiempo_gestion_dias,
    CASE l_returnflag WHEN 'R' THEN 'En  Proceso' WHEN 'A' THEN 'CERRADO' ELSE 'Abierto' END AS estado,
    CASE WHEN l_linenumber = 7 THEN 'x' WHEN l_linenumber = 6 THEN '0' ELSE CAST(43000 + l_suppkey AS VARCHAR) END AS fecha_creacion
    FROM lineitem)"""


def _raw(spark, sf):
    line = table(spark, sf, "lineitem")
    quantity = F.col("l_quantity").cast("string")
    kind = F.col("l_linenumber") % 4
    return line.select(
        F.lpad(F.col("l_orderkey").cast("string"), 8, "0").alias("id_pqr"),
        F.when(kind == 0, F.concat(F.lit("  "), quantity))
        .when(kind == 1, F.concat(quantity, F.lit("d")))
        .when(kind == 2, F.lit("NaN"))
        .otherwise(quantity)
        .alias("tiempo_gestion_dias"),
        F.when(F.col("l_returnflag") == "R", F.lit("En  Proceso"))
        .when(F.col("l_returnflag") == "A", F.lit("CERRADO"))
        .otherwise(F.lit("Abierto"))
        .alias("estado"),
        F.when(F.col("l_linenumber") == 7, F.lit("x"))
        .when(F.col("l_linenumber") == 6, F.lit("0"))
        .otherwise((F.col("l_suppkey") + 43000).cast("string"))
        .alias("fecha_creacion"),
    )


_DAYS_SQL = r"CASE WHEN regexp_matches(trim(tiempo_gestion_dias), '^[+-]?(\d+(\.\d*)?|\.\d+)$') THEN CAST(trim(tiempo_gestion_dias) AS DOUBLE) END"
_STATUS_SQL = r"regexp_replace(lower(estado), '\s+', '_', 'g')"
_DATE_SQL = "CASE WHEN TRY_CAST(fecha_creacion AS INTEGER) > 0 THEN DATE '1899-12-30' + TRY_CAST(fecha_creacion AS INTEGER) END"


@query("src08_rename_columns", f"WITH {RAW} SELECT id_pqr AS case_id, tiempo_gestion_dias AS handling_days, estado AS status, fecha_creacion AS opened_on FROM raw")
def rename_columns(spark, sf):
    return readers.rename_columns(_raw(spark, sf))


@query("src09_to_double", f"WITH {RAW} SELECT tiempo_gestion_dias, {_DAYS_SQL} AS days FROM raw")
def tolerant_double(spark, sf):
    return _raw(spark, sf).select("tiempo_gestion_dias", to_double(F.col("tiempo_gestion_dias")).alias("days"))


@query("src10_normalize_status", f"WITH {RAW} SELECT id_pqr, {_STATUS_SQL} AS status FROM raw")
def normalized_status(spark, sf):
    return _raw(spark, sf).select("id_pqr", normalize_status(F.col("estado")).alias("status"))


@query("src11_spreadsheet_date", f"WITH {RAW} SELECT fecha_creacion, {_DATE_SQL} AS opened_on FROM raw")
def spreadsheet_dates(spark, sf):
    return _raw(spark, sf).select("fecha_creacion", spreadsheet_date(F.col("fecha_creacion")).alias("opened_on"))


@query(
    "src12_normalize_cases",
    f"""WITH {RAW} SELECT CAST(id_pqr AS BIGINT) AS case_id, {_DAYS_SQL} AS handling_days, {_STATUS_SQL} AS status,
      {_DATE_SQL} AS opened_on FROM raw""",
)
def normalize_cases(spark, sf):
    return readers.normalize_cases(_raw(spark, sf))


CONTROL = """control AS (SELECT CAST(o_custkey AS VARCHAR) AS batch_id, sha256(CAST(o_custkey AS VARCHAR)) AS file_hash,
    CASE min(o_orderstatus) WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status,
    count(*) AS records, min(o_orderdate) AS started_at, max(o_orderdate) AS completed_at FROM orders GROUP BY o_custkey)"""


def _control(spark, sf):
    key = F.col("o_custkey").cast("string")
    return (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.min("o_orderstatus").alias("_s"),
            F.count(F.lit(1)).alias("records"),
            F.min("o_orderdate").alias("started_at"),
            F.max("o_orderdate").alias("completed_at"),
        )
        .select(
            key.alias("batch_id"),
            F.sha2(key, 256).alias("file_hash"),
            F.when(F.col("_s") == "F", F.lit("completed")).when(F.col("_s") == "O", F.lit("failed")).otherwise(
                F.lit("processing")
            ).alias("status"),
            "records",
            "started_at",
            "completed_at",
        )
    )


@query(
    "src13_pending_files",
    f"""WITH {CONTROL} SELECT c_name AS file_name, sha256(CAST(c_custkey AS VARCHAR)) AS sha256 FROM customer
    WHERE sha256(CAST(c_custkey AS VARCHAR)) NOT IN (SELECT file_hash FROM control WHERE status = 'completed')""",
)
def pending_files(spark, sf):
    files = table(spark, sf, "customer").select(
        F.col("c_name").alias("file_name"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256")
    )
    return sinks.pending_files(files, _control(spark, sf)).select("file_name", "sha256")


@query(
    "src14_upsert_batches",
    f"""WITH {CONTROL}, fresh AS (SELECT CAST(c_custkey AS VARCHAR) AS batch_id, 'new' AS file_hash,
        CASE WHEN c_acctbal > 5000 THEN 'completed' ELSE 'processing' END AS status, CAST(c_nationkey AS BIGINT) AS records,
        TIMESTAMP '2001-01-01' AS started_at,
        CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2001-01-02' END AS completed_at
        FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT * FROM control WHERE batch_id NOT IN (SELECT batch_id FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def upsert_batches(spark, sf):
    fresh = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("batch_id"),
        F.lit("new").alias("file_hash"),
        F.when(F.col("c_acctbal") > 5000, F.lit("completed")).otherwise(F.lit("processing")).alias("status"),
        F.col("c_nationkey").cast("long").alias("records"),
        F.expr("timestamp_ntz'2001-01-01'").alias("started_at"),
        F.expr("timestamp_ntz'2001-01-02'").alias("completed_at"),
    )
    return sinks.upsert_batches(_control(spark, sf), fresh)


@query(
    "src14_latest_batches",
    """SELECT CAST(user_id AS VARCHAR) AS batch_id, ts AS started_at, event_type AS status FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS place FROM events) WHERE place = 1""",
)
def latest_batches(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("batch_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("status")
    )
    return sinks.latest_batches(log)


@query(
    "src15_quarantine",
    with_cases(
        """SELECT 'SCHEMA_VALIDATION' AS rule_id, 'no closing date' AS reason, case_id FROM cases
        WHERE status = 'cerrado' AND closed_on IS NULL"""
    ),
)
def quarantine(spark, sf):
    path = _scratch(spark, "quarantine")
    bad = cases(spark, sf).where("status = 'cerrado' AND closed_on IS NULL")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sinks.write_quarantine(sinks.quarantine_rows(bad, at, "SCHEMA_VALIDATION", "no closing date"), path)
    return sinks.read_quarantine(spark, path).select(
        "rule_id", "reason", F.get_json_object("record_data", "$.case_id").cast("long").alias("case_id")
    )


@query("src16_write_table", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def write_table(spark, sf):
    path = _scratch(spark, "table")
    sinks.write_table(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path)
    return spark.read.parquet(path)


@query(
    "src17_insert_missing",
    """WITH target AS (SELECT o_custkey AS key, min(o_orderkey) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
      source AS (SELECT o_custkey AS key, min(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT * FROM target UNION ALL SELECT * FROM source WHERE key NOT IN (SELECT key FROM target)""",
)
def insert_missing(spark, sf):
    path = _scratch(spark, "upsert")
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), "o_orderpriority", "o_orderstatus"
    )
    first = orders.where("o_orderpriority = '1-URGENT'").select("key", "value")
    second = orders.where("o_orderstatus = 'F'").select("key", "value")
    for batch in (first, second, second):
        sinks.insert_missing(spark, path, batch, ["key"])
    return spark.read.parquet(path)


@query("src20_audit_lines", """SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result FROM events WHERE event_type <> 'view'""")
def audit_lines(spark, sf):
    path = _scratch(spark, "audit")
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        kind.alias("action"),
        F.lit("case").alias("resource"),
        F.when(kind == "error", F.lit("failure")).when(kind == "view", F.lit("seen")).otherwise(F.lit("success")).alias("result"),
    )
    sinks.append_audit(rows, path)
    return readers.read_audit(spark, path).select("event_id", "user_id", "action", "result")


@query(
    "src21_verify_table",
    with_cases(
        f"""SELECT count(*) AS rows, CAST(13 AS BIGINT) AS columns, count(DISTINCT cause) AS distinct_causes,
        {rnd("avg(handling_days)", 2)} AS mean_days, {rnd("median(handling_days)", 2)} AS median_days,
        {rnd("quantile_cont(handling_days, 0.9)", 2)} AS p90_days FROM cases"""
    ),
)
def verify_table(spark, sf):
    return kpis.verify_table(cases(spark, sf))


@query("src21_status_distribution", with_cases("SELECT status, count(*) AS count FROM cases GROUP BY status"))
def status_distribution(spark, sf):
    return kpis.status_distribution(cases(spark, sf, "status"))


def _people(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("Nombre_Cliente"),
        F.when(F.col("c_nationkey") == 3, F.lit("")).when(F.col("c_nationkey") == 4, F.lit(None).cast("string")).otherwise(
            F.substring("c_mktsegment", 1, F.col("c_nationkey") % 4 + 1)
        ).alias("correo"),
        F.col("c_mktsegment").alias("segment"),
    )


_MASK = """CASE WHEN {c} IS NULL THEN NULL WHEN length({c}) >= 3 THEN left({c}, 1) || repeat('*', length({c}) - 2) || right({c}, 1)
  WHEN length({c}) > 0 THEN left(sha256({c}), 8) ELSE {c} END"""
PEOPLE = """people AS (SELECT c_custkey AS id, c_name AS nombre, CASE c_nationkey WHEN 3 THEN '' WHEN 4 THEN NULL
  ELSE left(c_mktsegment, c_nationkey % 4 + 1) END AS correo, c_mktsegment AS segment FROM customer)"""


@query(
    "pii01_pii_columns",
    f"""WITH {PEOPLE} SELECT 'Nombre_Cliente' AS column_name, count(nombre) AS values,
      count(*) FILTER (WHERE length(nombre) BETWEEN 1 AND 2) AS hashed FROM people
    UNION ALL SELECT 'correo', count(correo), count(*) FILTER (WHERE length(correo) BETWEEN 1 AND 2) FROM people""",
)
def pii_columns(spark, sf):
    return privacy.pii_report(_people(spark, sf))


@query("pii02_mask_text", f"SELECT doc_id, {_MASK.format(c='text')} AS masked FROM documents")
def mask_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", privacy.mask(F.col("text")).alias("masked"))


@query(
    "pii03_mask_table",
    f"""WITH {PEOPLE} SELECT id, {_MASK.format(c="nombre")} AS "Nombre_Cliente", {_MASK.format(c="correo")} AS correo, segment FROM people""",
)
def mask_table(spark, sf):
    return privacy.mask_table(_people(spark, sf))


def _dirty(spark, sf):
    """Cases with broken values derived from line numbers and flags."""
    number = F.col("l_linenumber")
    line = table(spark, sf, "lineitem")
    return line.select(
        F.when(F.col("l_suppkey") == 1, F.lit(None).cast("long")).otherwise(F.col("l_orderkey")).alias("case_id"),
        F.col("l_shipdate").cast("date").alias("opened_on"),
        F.when(number == 1, F.lit(" En Proceso ")).when(number == 2, F.lit("PAUSADO")).when(number == 3, F.lit(None).cast("string")).otherwise(
            F.lit("Cerrado")
        ).alias("status"),
        F.when(F.col("l_returnflag") == "R", F.lit(" Queja")).when(F.col("l_quantity") < 5, F.lit(None).cast("string")).when(
            F.col("l_quantity") > 48, F.lit("otro")
        ).otherwise(F.lit("RECLAMO")).alias("case_type"),
        F.when(F.col("l_discount") == 0.05, F.lit("  ")).otherwise(F.lit("cause")).alias("cause"),
        F.when(F.col("l_tax") == 0.03, F.lit(None).cast("string")).otherwise(F.lit("web")).alias("channel"),
        F.lit("company").alias("company"),
        (F.col("l_quantity") - 3).alias("handling_days"),
    )


DIRTY = r"""dirty AS (SELECT CASE WHEN l_suppkey <> 1 THEN l_orderkey END AS case_id, CAST(l_shipdate AS DATE) AS opened_on,
    CASE l_linenumber WHEN 1 THEN ' En Proceso ' WHEN 2 THEN 'PAUSADO' WHEN 3 THEN NULL ELSE 'Cerrado' END AS status,
    CASE WHEN l_returnflag = 'R' THEN ' Queja' WHEN l_quantity < 5 THEN NULL WHEN l_quantity > 48 THEN 'otro' ELSE 'RECLAMO' END AS case_type,
    CASE WHEN l_discount = 0.05e0 THEN '  ' ELSE 'cause' END AS cause,
    CASE WHEN l_tax = 0.03e0 THEN NULL ELSE 'web' END AS channel, 'company' AS company, l_quantity - 3 AS handling_days FROM lineitem),
  cleaned AS (SELECT case_id, opened_on, regexp_replace(lower(trim(status)), '\s+', '_', 'g') AS status,
    lower(trim(case_type)) AS case_type, trim(cause) AS cause, trim(channel) AS channel, company, handling_days FROM dirty),
  ruled AS (SELECT *, case_id IS NULL AS r1, status IS NOT NULL AND status NOT IN ('cerrado', 'en_proceso', 'abierto') AS r2,
    status IS NULL AND case_id IS NOT NULL AS r3,
    case_type IS NOT NULL AND case_type NOT IN ('peticion', 'queja', 'reclamo') AS r4, case_type IS NULL AS r5,
    cause IS NULL OR cause = '' AS r6, channel IS NULL OR channel = '' AS r7, company IS NULL OR company = '' AS r8,
    coalesce(handling_days < 0, false) AS r9 FROM cleaned),
  failed AS (
    SELECT CAST(case_id AS VARCHAR) AS record_id, 'case_id' AS failed_field, 'not_null' AS rule_violated, CAST(case_id AS VARCHAR) AS rejected_value FROM ruled WHERE r1
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'status', 'isin:cerrado,en_proceso,abierto', status FROM ruled WHERE r2
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'status', 'not_null', status FROM ruled WHERE r3
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'case_type', 'isin:peticion,queja,reclamo', case_type FROM ruled WHERE r4
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'case_type', 'not_null', case_type FROM ruled WHERE r5 AND NOT (r1 OR r2 OR r3 OR r4)
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'cause', 'not_null_or_empty', cause FROM ruled WHERE r6 AND NOT (r1 OR r2 OR r3 OR r4 OR r5)
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'channel', 'not_null_or_empty', channel FROM ruled WHERE r7 AND NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6)
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'company', 'not_null_or_empty', company FROM ruled WHERE r8 AND NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7)
    UNION ALL SELECT CAST(case_id AS VARCHAR), 'handling_days', 'ge:0', CAST(handling_days AS VARCHAR) FROM ruled
      WHERE r9 AND NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8)),
  good AS (SELECT * FROM ruled WHERE NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9))"""


def _contract_reason(unique: bool) -> str:
    rules = [(f"{c} IS NULL", f"{c}: null") for c in ("case_id", "opened_on", "status", "cause", "channel", "company", "case_type")]
    rules += [
        ("opened_on < DATE '1998-01-01'", "opened_on: before 1998-01-01"),
        ("status NOT IN ('cerrado', 'en_proceso', 'abierto')", "status: not in domain"),
        ("case_type NOT IN ('peticion', 'queja', 'reclamo')", "case_type: not in domain"),
        ("handling_days < 0", "handling_days: negative"),
    ]
    if unique:
        rules.append(("case_id IN (SELECT case_id FROM cleaned WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) > 1)", "case_id: not unique"))
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in rules) + ")"


@query(
    "val01_quarantined",
    f"""WITH {DIRTY} SELECT * FROM (SELECT case_id, opened_on, status, handling_days, 'SCHEMA_VALIDATION' AS rule_id,
      {_contract_reason(True)} AS reason FROM cleaned) WHERE reason <> ''""",
)
def quarantined(spark, sf):
    _, bad = contract.validate_contract(contract.clean(_dirty(spark, sf)), "1998-01-01")
    return bad.select("case_id", "opened_on", "status", "handling_days", "rule_id", "reason")


@query(
    "val01_valid_row_by_row",
    f"""WITH {DIRTY} SELECT * FROM cleaned WHERE {_contract_reason(False)} = ''""",
)
def valid_rows(spark, sf):
    good, _ = contract.validate_contract(contract.clean(_dirty(spark, sf)), "1998-01-01", enforce_unique=False)
    return good


@query("val02_clean", f"WITH {DIRTY} SELECT * FROM cleaned")
def clean(spark, sf):
    return contract.clean(_dirty(spark, sf))


@query("val03_migration_failures", f"WITH {DIRTY} SELECT * FROM failed")
def migration_failures(spark, sf):
    return contract.migration_failures(contract.clean(_dirty(spark, sf)))


@query(
    "val04_reconcile",
    f"""WITH {DIRTY} SELECT *, source_count = loaded_count + quarantined_count AS match FROM (SELECT
      (SELECT count(*) FROM dirty) AS source_count, (SELECT count(*) FROM good) AS loaded_count,
      (SELECT count(*) FROM failed) AS quarantined_count, (SELECT count(DISTINCT record_id) FROM failed) AS failed_records)""",
)
def reconcile(spark, sf):
    cleaned = contract.clean(_dirty(spark, sf))
    return contract.reconcile(cleaned, contract.migration_valid(cleaned), contract.migration_failures(cleaned))


@query(
    "val05_migration_report",
    f"""WITH {DIRTY} SELECT *, {rnd("success_count * 100e0 / total_records", 2)} AS success_rate,
      CASE WHEN success_count * 100e0 / total_records >= 95 THEN 'completed' ELSE 'failed' END AS status FROM (SELECT
      (SELECT count(*) FROM dirty) AS total_records, (SELECT count(*) FROM good) AS success_count,
      (SELECT count(*) FROM dirty) - (SELECT count(*) FROM good) AS failed_count,
      (SELECT count(*) FROM failed) AS quarantined_count)""",
)
def migration_report(spark, sf):
    return contract.migration_report(contract.clean(_dirty(spark, sf)))
