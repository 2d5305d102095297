"""The case contract: columns, types, domains, thresholds. Everything else takes these as defaults."""

from __future__ import annotations

from pyspark.sql import types as T

CASE_SCHEMA = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("opened_on", T.DateType()),
        T.StructField("closed_on", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("cause", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("owner_unit", T.StringType()),
        T.StructField("marking", T.StringType()),
        T.StructField("close_reason", T.StringType()),
        T.StructField("handling_days", T.DoubleType()),
        T.StructField("case_type", T.StringType()),
    ]
)
CASE_COLUMNS = CASE_SCHEMA.fieldNames()
REQUIRED = ("case_id", "opened_on", "status", "cause", "channel", "company", "case_type")

# Source column names and the names used here.
SOURCE_NAMES = {
    "id_pqr": "case_id",
    "fecha_creacion": "opened_on",
    "fecha_cierre": "closed_on",
    "estado": "status",
    "causa": "cause",
    "canal_atencion": "channel",
    "empresa": "company",
    "resultado": "outcome",
    "unidad_responsable": "owner_unit",
    "marcacion": "marking",
    "motivo_cierre": "close_reason",
    "tiempo_gestion_dias": "handling_days",
    "tipo_pqr": "case_type",
}

# Domains.
CLOSED = "cerrado"
IN_PROCESS = "en_proceso"
OPEN = "abierto"
STATUSES = (CLOSED, IN_PROCESS, OPEN)
REPORT_STATUSES = ("cerrado", "en_tramite", "en_proceso", "abierto")
CASE_TYPES = ("peticion", "queja", "reclamo")
GRANTED = "accede"
OTHERS_LABEL = "Otras causas"
EARLIEST_OPENING = "2020-01-01"

# Thresholds.
MIN_GROUP = 5
LOW_SAMPLE = 30
HIGH_CONCENTRATION = 0.40
MAIN_CAUSE_CONFIRMED = 0.45
PARETO_CUT = 0.80
TYPE_SHARE = 0.80
CATEGORICAL_LIMIT = 50
IQR_FENCE = 1.5
SIMILARITY = 0.85
SIGNIFICANCE = 0.05
QUALITY_WEIGHTS = {
    "completeness": 0.25,
    "validity": 0.20,
    "consistency": 0.20,
    "uniqueness": 0.15,
    "timeliness": 0.10,
    "referential_integrity": 0.10,
}
