"""Full quality report: per-column profile, table metrics, quick score, and what could not be computed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from casemill.operators.profiling import column_values, dataset_metrics, infer_types, profile_columns
from casemill.operators.quality import DIMENSIONS, composite
from casemill.session import durable

SCHEMA_VERSION = "1.0"


@dataclass(frozen=True)
class QualityReport:
    """``summary`` is one row; ``columns`` has one row per profiled column."""

    summary: DataFrame
    columns: DataFrame
    errors: tuple[str, ...]


def quality_report(df: DataFrame, as_of: date, id_column: str = "case_id", stored: bool = False) -> QualityReport:
    """Profile a table. A column that cannot be profiled is named in ``errors`` and left out.

    ``stored`` tells that ``df`` is a stored table, whose columns can be read one by one. Columns are checked for support by type; none left is an error of the whole report.
    """
    errors: list[str] = []
    usable: list[str] = []
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct", "binary", "variant")):
            errors.append(f"{name}: type {kind.split('<')[0]} has no profile")
        else:
            usable.append(name)
    if not usable:
        raise ValueError("no column can be profiled: " + "; ".join(errors))
    table = df.select(*usable)
    values = durable(column_values(table, stored=stored))
    types = durable(infer_types(table, values))
    columns = durable(profile_columns(table, values, types))
    metrics = dataset_metrics(table, id_column, values, types)
    scores = {
        "completeness": F.col("overall_completeness_pct"),
        "validity": F.col("overall_validity_pct"),
        "consistency": F.lit(100.0),
        "uniqueness": F.lit(100.0) - F.col("duplication_rate"),
        "timeliness": F.lit(100.0),
        "referential_integrity": F.lit(100.0),
    }
    summary = metrics.select("*", *[c.alias(d) for d, c in scores.items()]).select(
        F.lit(as_of).cast("date").alias("as_of"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        *metrics.columns,
        *DIMENSIONS,
        composite({d: F.col(d) for d in DIMENSIONS}).alias("composite_score"),
        F.lit("; ".join(errors)).alias("errors"),
    )
    return QualityReport(summary, columns, tuple(errors))
