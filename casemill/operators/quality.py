"""Quality dimensions, composite scores and violation tables.

Each report folds all its rules into one row of counters, so the facts are scanned once; ids and
row tuples, which need a distinct count, are the only extra pass. Reports are then arithmetic on one
row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import count_when, round_to, share
from casemill.functions.severity import violation_severity
from casemill.operators.profiling import dataset_metrics, duplicate_report
from casemill.schema import (
    CASE_TYPES,
    CLOSED,
    EARLIEST_OPENING,
    GRANTED,
    QUALITY_WEIGHTS,
    REPORT_STATUSES,
    STATUSES,
)

DIMENSIONS = tuple(QUALITY_WEIGHTS)
# Dimensions that the data-only fallback report does not compute.
FALLBACK_SCORES = {
    "validity": 85.0,
    "consistency": 80.0,
    "uniqueness": 98.0,
    "timeliness": 90.0,
    "referential_integrity": 85.0,
}
FALLBACK_FIELDS = ("cause", "company", "close_reason", "marking")


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(share(part, whole), F.lit(0.0))


def _score(bad: Column, whole: Column) -> Column:
    """100 minus the bad percentage, floored at zero, 100 without rows; two places."""
    return round_to(F.greatest(F.lit(100.0) - _pct(bad, whole), F.lit(0.0)), 2)


def catalog_mismatches(df: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Per catalogued field: non-null values checked and values missing from the catalog.

    ``catalogs`` holds (field, value). A field without catalog rows accepts everything and is not
    checked. Values are counted before they meet the catalog, so the join is as small as the domains.
    """
    listed = catalogs.where(F.col("field").isin(df.columns)).select("field").distinct()
    fields = sorted(row["field"] for row in listed.collect())  # at most one per table column
    if not fields:
        return catalogs.limit(0).select("field", F.lit(0).alias("checked"), F.lit(0).alias("unmatched"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    counted = (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = catalogs.select("field", "value").distinct().withColumn("known", F.lit(True))
    return (
        counted.join(known, ["field", "value"], "left")
        .groupBy("field")
        .agg(
            F.sum("n").alias("checked"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unmatched"),
        )
    )


def _counters(df: DataFrame, as_of: date, min_date: str) -> DataFrame:
    status, kind, time = F.col("status"), F.col("case_type"), F.col("handling_days")
    opened, closed = F.col("opened_on"), F.col("closed_on")
    first, last = F.lit(min_date).cast("date"), F.lit(as_of).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"has_{c}") for c in df.columns],
        count_when(~status.isin(*STATUSES)).alias("bad_status"),
        count_when(~kind.isin(*CASE_TYPES)).alias("bad_type"),
        count_when(time < 0).alias("bad_time"),
        count_when((status == CLOSED) & closed.isNull()).alias("no_closing_date"),
        count_when((F.col("outcome") == GRANTED) & (time == 0)).alias("granted_at_once"),
        count_when(closed < opened).alias("closed_early"),
        count_when((opened < first) | (opened > last)).alias("bad_date"),
    )


_MISMATCHES = "array<struct<field:string,unmatched:bigint>>"


def _report(
    df: DataFrame,
    as_of: date,
    catalogs: DataFrame | None,
    min_date: str,
    id_column: str,
    with_ids: bool = True,
) -> DataFrame:
    """One row with every counter of the six dimensions; the id count can be left out."""
    row = _counters(df, as_of, min_date)
    if with_ids:
        row = row.crossJoin(F.broadcast(duplicate_report(df, id_column)))  # one row each
    if catalogs is None:
        return row.withColumns({"checked": F.lit(0), "unmatched": F.lit(0), "mismatches": F.array().cast(_MISMATCHES)})
    found = catalog_mismatches(df, catalogs)
    per_field = F.struct(F.col("field"), F.col("unmatched"))
    summary = found.agg(
        F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched"),
        F.sort_array(F.collect_list(per_field)).alias("mismatches"),  # one entry per table column at most
    )
    return row.crossJoin(F.broadcast(summary))


def _dimension_columns(columns: Sequence[str]) -> dict[str, Column]:
    n = F.col("n")
    filled = sum((F.col(f"has_{c}") for c in columns), F.lit(0))
    checks = n * 3 + F.col("has_handling_days")
    conforming = (
        (n - F.col("bad_status"))
        + (n - F.col("bad_type"))
        + (F.col("has_handling_days") - F.col("bad_time"))
        + F.col("has_opened_on")
    )
    contradictions = F.col("no_closing_date") + F.col("granted_at_once") + F.col("closed_early")
    return {
        "completeness": F.coalesce(round_to(share(filled, n * len(columns)), 2), F.lit(100.0)),
        "validity": F.coalesce(round_to(share(conforming, checks), 2), F.lit(100.0)),
        "consistency": _score(contradictions, n),
        "uniqueness": round_to(F.greatest(F.lit(100.0) - F.col("duplication_rate"), F.lit(0.0)), 2),
        "timeliness": _score(F.col("bad_date"), n),
        "referential_integrity": _score(F.col("unmatched"), F.col("checked")),
    }


def composite(scores: dict[str, Column]) -> Column:
    """Weighted sum of the six dimensions, two places."""
    return round_to(sum((scores[d] * F.lit(w) for d, w in QUALITY_WEIGHTS.items()), F.lit(0.0)), 2)


def quality_counters(
    df: DataFrame,
    as_of: date,
    catalogs: DataFrame | None = None,
    min_date: str = EARLIEST_OPENING,
    id_column: str = "case_id",
) -> DataFrame:
    """One row with every counter behind :func:`quality_score` and :func:`violations`, for callers that need both."""
    return _report(df, as_of, catalogs, min_date, id_column)


def quality_score(
    df: DataFrame,
    as_of: date,
    catalogs: DataFrame | None = None,
    min_date: str = EARLIEST_OPENING,
    id_column: str = "case_id",
    counters: DataFrame | None = None,
) -> DataFrame:
    """One row: the six dimensions and the composite. ``counters`` are those of the same arguments, if at hand."""
    scores = _dimension_columns(df.columns)
    report = _report(df, as_of, catalogs, min_date, id_column) if counters is None else counters
    row = report.select(*[c.alias(d) for d, c in scores.items()])
    return row.withColumn("composite_score", composite({d: F.col(d) for d in DIMENSIONS}))


def _dimension(name: str):
    def one(
        df: DataFrame,
        as_of: date,
        catalogs: DataFrame | None = None,
        min_date: str = EARLIEST_OPENING,
        id_column: str = "case_id",
    ) -> DataFrame:
        listed = catalogs if name == "referential_integrity" else None
        row = _report(df, as_of, listed, min_date, id_column, with_ids=name == "uniqueness")
        return row.select(_dimension_columns(df.columns)[name].alias(name))

    one.__name__ = name
    one.__doc__ = f"The {name.replace('_', ' ')} dimension alone; counters it does not use are pruned."
    return one


completeness = _dimension("completeness")
validity = _dimension("validity")
consistency = _dimension("consistency")
uniqueness = _dimension("uniqueness")
timeliness = _dimension("timeliness")
referential_integrity = _dimension("referential_integrity")


def _violation(rule: Column | str, field: Column | str, count: Column, pct: Column, action: Column | str) -> Column:
    def text(value):
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        text(rule).alias("rule_name"),
        text(field).alias("target_field"),
        count.cast("long").alias("violations_count"),
        pct.cast("double").alias("_pct"),
        text(action).alias("corrective_action"),
    )


def violations(
    df: DataFrame,
    as_of: date,
    catalogs: DataFrame | None = None,
    min_date: str = EARLIEST_OPENING,
    id_column: str = "case_id",
    counters: DataFrame | None = None,
) -> DataFrame:
    """One row per broken rule with count, percentage of rows, severity and what to do.

    ``counters`` are the :func:`quality_counters` of the same arguments, if at hand.
    """
    n = F.col("n")

    def rule(name: str, field: str, counter: str, action: str) -> Column:
        return _violation(name, field, F.col(counter), _pct(F.col(counter), n), action)

    rows = [
        _violation(
            "completeness_null_values", c, n - F.col(f"has_{c}"), _pct(n - F.col(f"has_{c}"), n),
            f"Find out why '{c}' is missing; fill it at the source",
        )
        for c in df.columns
    ]
    rows += [
        rule("validity_status_domain", "status", "bad_status", "Map status values to the allowed ones"),
        rule("validity_case_type_domain", "case_type", "bad_type", "Map case types to the allowed ones"),
        rule("validity_handling_days_range", "handling_days", "bad_time", "Correct negative handling times"),
        _violation(
            "validity_opened_on_format", "opened_on", n - F.col("has_opened_on"),
            _pct(n - F.col("has_opened_on"), n), "Supply a valid opening date",
        ),
        rule("consistency_closed_without_date", "status, closed_on", "no_closing_date",
             "Supply the closing date or correct the status"),
        rule("consistency_granted_at_zero_days", "outcome, handling_days", "granted_at_once",
             "Check the handling time of granted cases"),
        rule("consistency_closed_before_opened", "closed_on, opened_on", "closed_early",
             "Correct the order of opening and closing dates"),
        _violation(
            "uniqueness_duplicate_identifiers", id_column, F.col("duplicate_count"), F.col("duplication_rate"),
            F.concat(F.lit("Remove repeated ids; affected: "), F.col("repeated_identifiers").cast("string")),
        ),
        rule("timeliness_date_range", "opened_on", "bad_date", "Correct opening dates outside the valid range"),
    ]
    mismatched = F.transform(
        "mismatches",
        lambda m: _violation(
            "referential_integrity_catalog_mismatch", m["field"], m["unmatched"],
            _pct(m["unmatched"], n), "Standardise the value or extend the catalog",
        ),
    )
    report = _report(df, as_of, catalogs, min_date, id_column) if counters is None else counters
    every = F.array(*rows)
    listed = F.concat(every, mismatched) if catalogs is not None else every
    return (
        report.select(F.inline(listed))
        .where(F.col("violations_count") > 0)
        .select(
            "rule_name",
            "target_field",
            "violations_count",
            round_to(F.col("_pct"), 2).alias("violations_percentage"),
            violation_severity(F.col("_pct")).alias("severity"),
            "corrective_action",
        )
        .orderBy("rule_name", "target_field")
    )


def quick_score(df: DataFrame, id_column: str = "case_id") -> DataFrame:
    """Composite from profiling alone; the three dimensions it cannot see count as perfect."""
    scores = {
        "completeness": F.col("overall_completeness_pct"),
        "validity": F.col("overall_validity_pct"),
        "consistency": F.lit(100.0),
        "uniqueness": F.lit(100.0) - F.col("duplication_rate"),
        "timeliness": F.lit(100.0),
        "referential_integrity": F.lit(100.0),
    }
    row = dataset_metrics(df, id_column).select(*[c.alias(d) for d, c in scores.items()])
    return row.withColumn("composite_score", composite({d: F.col(d) for d in DIMENSIONS}))


def fallback_quality(df: DataFrame) -> DataFrame:
    """Four-field completeness from the data, the other dimensions as fixed estimates."""
    counted = df.agg(F.count(F.lit(1)).alias("record_count"), *[F.count(c).alias(c) for c in FALLBACK_FIELDS])
    ratios = [round_to(share(F.col(c), F.col("record_count")), 2) for c in FALLBACK_FIELDS]
    mean = round_to(sum(ratios[1:], ratios[0]) / len(ratios), 2)
    row = counted.select("record_count", mean.alias("completeness"), *[F.lit(v).alias(d) for d, v in FALLBACK_SCORES.items()])
    return row.withColumn("composite_score", composite({d: F.col(d) for d in DIMENSIONS}))


# ---- report plane: same dimensions, defined over rows and with its own rule ids --------------------

ALWAYS_REQUIRED = ("cause", "company", "channel", "status", "opened_on")
REQUIRED_WHEN_CLOSED = ("closed_on", "close_reason")
TUPLE_FIELDS = ("cause", "company", "channel", "status", "outcome", "opened_on", "handling_days")
DOMAIN_FIELDS = ("company", "channel", "owner_unit")
REPORT_DIMENSIONS = (*DIMENSIONS[:-1], "domain_conformity")

# Rule ids of the report plane.
REPORT_RULES = {
    "cause": "COMP-CAUSA",
    "company": "COMP-EMPRESA",
    "channel": "COMP-CANAL_ATENCION",
    "status": "COMP-ESTADO",
    "opened_on": "COMP-FECHA_CREACION",
    "close_reason": "COMP-MOTIVO_CIERRE",
    "closed_on": "COMP-FECHA_CIERRE",
    "negative_time": "VAL-TIEMPO_NEG",
    "bad_status": "VAL-ESTADO_INVALIDO",
    "no_closing_date": "CONS-CERRADO_SIN_CIERRE",
    "closed_early": "CONS-CIERRE_ANTES_CREACION",
    "repeated_rows": "UNIQ-EXACT_DUPLICATES",
}


def _pct2(ratio: Column) -> Column:
    """Ratio as a percentage with two places."""
    return F.round(ratio * 10000.0) / 100.0


def _ratio(part: Column, whole: Column) -> Column:
    # An empty whole counts as one, so its ratio is zero.
    return part / F.greatest(whole, F.lit(1)).cast("double")


def _report_counters(
    df: DataFrame, everything: DataFrame, as_of: date, with_tuples: bool = True
) -> DataFrame:
    status, time = F.col("status"), F.col("handling_days")
    opened, closed = F.col("opened_on"), F.col("closed_on")
    is_closed = status == CLOSED
    no_date = is_closed & closed.isNull()
    early = closed < opened
    newest = everything.agg(F.date_sub(F.max("opened_on"), 365).alias("_since"))
    row = (
        df.crossJoin(F.broadcast(newest))  # exactly one row
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(c).alias(f"has_{c}") for c in sorted({*ALWAYS_REQUIRED, *DOMAIN_FIELDS})],
            count_when(is_closed).alias("n_closed"),
            *[count_when(is_closed & F.col(c).isNotNull()).alias(f"closed_{c}") for c in REQUIRED_WHEN_CLOSED],
            count_when(time < 0).alias("negative_time"),
            count_when(~status.isin(*REPORT_STATUSES)).alias("bad_status"),
            count_when(opened > F.lit(as_of).cast("date")).alias("future_date"),
            count_when(
                F.coalesce(no_date, F.lit(False)) | F.coalesce(early, F.lit(False)) | F.coalesce(time < 0, F.lit(False))
            ).alias("inconsistent"),
            count_when(no_date).alias("no_closing_date"),
            count_when(early).alias("closed_early"),
            count_when(opened >= F.col("_since")).alias("recent"),
            *[count_when(F.length(F.trim(c)) > 1).alias(f"good_{c}") for c in DOMAIN_FIELDS],
        )
    )
    if not with_tuples:
        return row
    tuples = df.select(*TUPLE_FIELDS).distinct().agg(F.count(F.lit(1)).alias("n_tuples"))
    return row.crossJoin(F.broadcast(tuples))


def _required_fill() -> Column:
    ratios = [_ratio(F.col(f"has_{c}"), F.col("n")) for c in ALWAYS_REQUIRED]
    ratios += [_ratio(F.col(f"closed_{c}"), F.col("n_closed")) for c in REQUIRED_WHEN_CLOSED]
    return _pct2(sum(ratios[1:], ratios[0]) / len(ratios))


def conditional_completeness(df: DataFrame, as_of: date) -> DataFrame:
    """Mean of five always-required and two required-when-closed ratios."""
    return _report_counters(df, df, as_of, with_tuples=False).select(_required_fill().alias("completeness"))


def quality_report(df: DataFrame, as_of: date, everything: DataFrame | None = None) -> DataFrame:
    """One row of the report-plane dimensions. ``everything`` is the unfiltered table behind ``df``."""
    n = F.col("n")
    domains = [_ratio(F.col(f"good_{c}"), F.col(f"has_{c}")) for c in DOMAIN_FIELDS]
    invalid = F.col("negative_time") + F.col("bad_status") + F.col("future_date")
    scores = {
        "completeness": _required_fill(),
        "validity": _pct2(1.0 - _ratio(invalid, n)),
        "consistency": _pct2(1.0 - _ratio(F.col("inconsistent"), n)),
        "uniqueness": _pct2(_ratio(F.col("n_tuples"), n)),
        "timeliness": _pct2(_ratio(F.col("recent"), n)),
        "domain_conformity": _pct2(sum(domains[1:], domains[0]) / len(domains)),
    }
    counters = _report_counters(df, df if everything is None else everything, as_of)
    row = counters.select("n", *[c.alias(d) for d, c in scores.items()])
    weights = QUALITY_WEIGHTS.values()
    total = sum((F.col(d) * F.lit(w) for d, w in zip(REPORT_DIMENSIONS, weights)), F.lit(0.0))
    return row.select(
        F.col("n").alias("record_count"), *REPORT_DIMENSIONS, round_to(total, 2).alias("overall_score")
    )


def report_violations(df: DataFrame, as_of: date, everything: DataFrame | None = None) -> DataFrame:
    """Report-plane rule breaks, most frequent first. Future dates lower validity but have no row."""
    n, n_closed = F.greatest("n", F.lit(1)), F.greatest("n_closed", F.lit(1))

    def row(rule: str, dimension: str, field: str, count: Column, whole: Column, cuts: Iterable[tuple[float, str]], last: str) -> Column:
        ratio = count / whole.cast("double")
        severity = F.lit(last)
        for cut, name in reversed(list(cuts)):
            severity = F.when(ratio > cut, F.lit(name)).otherwise(severity)
        return F.struct(
            F.lit(REPORT_RULES[rule]).alias("rule_id"),
            F.lit(dimension).alias("dimension"),
            F.lit(field).alias("field"),
            count.cast("long").alias("count"),
            _pct2(ratio).alias("percentage"),
            severity.alias("severity"),
        )

    rows = [
        row(c, "completeness", c, n - F.col(f"has_{c}"), n, ((0.1, "HIGH"), (0.05, "MEDIUM")), "LOW")
        for c in ALWAYS_REQUIRED
    ]
    rows += [
        row("close_reason", "completeness", "close_reason", n_closed - F.col("closed_close_reason"), n_closed,
            ((0.1, "HIGH"),), "MEDIUM"),
        row("closed_on", "completeness", "closed_on", n_closed - F.col("closed_closed_on"), n_closed, (), "HIGH"),
        row("negative_time", "validity", "handling_days", F.col("negative_time"), n, (), "HIGH"),
        row("bad_status", "validity", "status", F.col("bad_status"), n, (), "MEDIUM"),
        row("no_closing_date", "consistency", "closed_on", F.col("no_closing_date"), n, ((0.05, "HIGH"),), "MEDIUM"),
        row("closed_early", "consistency", "closed_on, opened_on", F.col("closed_early"), n, (), "HIGH"),
        row("repeated_rows", "uniqueness", "(multiple)", F.col("n") - F.col("n_tuples"), n, ((0.1, "HIGH"),), "MEDIUM"),
    ]
    counters = _report_counters(df, df if everything is None else everything, as_of)
    return (
        counters.select(F.inline(F.array(*rows))).where(F.col("count") > 0).orderBy(F.desc("count"), "rule_id")
    )
