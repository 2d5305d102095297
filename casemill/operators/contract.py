"""Contract check and migration rules over case records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.numbers import round_to, share, to_double
from casemill.functions.text import normalize_status, strip
from casemill.schema import CASE_SCHEMA, CASE_TYPES, EARLIEST_OPENING, REQUIRED, STATUSES

RULE_ID = "SCHEMA_VALIDATION"
MIN_SUCCESS_PCT = 95.0


def coerce(df: DataFrame) -> DataFrame:
    """Cast contract columns to their types; what cannot be cast becomes null. Extra columns stay."""
    types = {f.name: f.dataType for f in CASE_SCHEMA.fields}
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name not in types or kind == types[name].simpleString():
            columns.append(c)
        elif types[name].simpleString() == "double":
            columns.append((to_double(c) if kind == "string" else c.try_cast("double")).alias(name))
        else:
            columns.append(c.try_cast(types[name]).alias(name))
    return df.select(*columns)


def _row_failures(df: DataFrame, min_date: str) -> list[Column]:
    """One nullable text column per broken rule."""

    def rule(broken: Column, reason: str) -> Column:
        return F.when(broken, F.lit(reason))

    checks = [rule(F.col(c).isNull(), f"{c}: null") for c in REQUIRED]
    checks += [
        rule(F.col("opened_on") < F.lit(min_date).cast("date"), f"opened_on: before {min_date}"),
        rule(~F.col("status").isin(*STATUSES), "status: not in domain"),
        rule(~F.col("case_type").isin(*CASE_TYPES), "case_type: not in domain"),
        rule(F.col("handling_days") < 0, "handling_days: negative"),
    ]
    return checks


def _keep_together(df: DataFrame) -> DataFrame:
    """Mark rows whose id occurs more than once.

    Ids are counted first and only repeated ones are joined back, so a hot id is one row on the
    joined side and its many copies can be split across tasks.
    """
    repeated = (
        df.where(F.col("case_id").isNotNull())
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
        .select("case_id", F.lit(True).alias("_repeated"))
    )
    return df.join(repeated, "case_id", "left")


def check_contract(
    df: DataFrame, min_date: str = EARLIEST_OPENING, enforce_unique: bool = True
) -> DataFrame:
    """Coerced rows with ``failures``: the broken rules joined by semicolons, empty for a valid row."""
    typed = coerce(df)
    names = typed.columns
    checks = _row_failures(typed, min_date)
    if enforce_unique:
        typed = _keep_together(typed)
        checks.append(F.when(F.col("_repeated"), F.lit("case_id: not unique")))
    return typed.select(*names, F.concat_ws("; ", *checks).alias("failures"))


def validate_contract(
    df: DataFrame, min_date: str = EARLIEST_OPENING, enforce_unique: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with rule id and reason)."""
    return split_contract(check_contract(df, min_date, enforce_unique))


def split_contract(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with rule id and reason) of a result of :func:`check_contract`."""
    valid = checked.where(F.col("failures") == "").drop("failures")
    reason = F.col("failures")
    bad = checked.where(F.col("failures") != "").select(
        *[c for c in checked.columns if c != "failures"], F.lit(RULE_ID).alias("rule_id"), reason.alias("reason")
    )
    return valid, bad


def clean(df: DataFrame) -> DataFrame:
    """Trim all text; status and type in lower case, blanks in a status joined by underscores."""
    columns = []
    for name, kind in df.dtypes:
        c = strip(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")
        if name == "status":
            c = normalize_status(c)
        elif name == "case_type":
            c = F.lower(c)
        columns.append(c.alias(name))
    return df.select(*columns)


@dataclass(frozen=True)
class _Rule:
    field: str
    name: str
    broken: Column
    # Whether the rule fires only on rows no earlier rule has rejected.
    only_if_valid: bool


def _migration_rules() -> list[_Rule]:
    status, kind, time = F.col("status"), F.col("case_type"), F.col("handling_days")

    def empty(name: str) -> Column:
        return F.col(name).isNull() | (F.length(name) == 0)

    return [
        _Rule("case_id", "not_null", F.col("case_id").isNull(), False),
        _Rule("status", "isin:" + ",".join(STATUSES), status.isNotNull() & ~status.isin(*STATUSES), False),
        _Rule("status", "not_null", status.isNull() & F.col("case_id").isNotNull(), False),
        _Rule("case_type", "isin:" + ",".join(CASE_TYPES), kind.isNotNull() & ~kind.isin(*CASE_TYPES), False),
        _Rule("case_type", "not_null", kind.isNull(), True),
        _Rule("cause", "not_null_or_empty", empty("cause"), True),
        _Rule("channel", "not_null_or_empty", empty("channel"), True),
        _Rule("company", "not_null_or_empty", empty("company"), True),
        _Rule("handling_days", "ge:0", F.coalesce(time < 0, F.lit(False)), True),
    ]


def _flagged(df: DataFrame) -> tuple[DataFrame, list[tuple[_Rule, Column]]]:
    """The rows with one flag per rule, and each rule with the condition under which it is reported.

    Flags are columns of their own, so cleaning expressions behind them are evaluated once per row.
    """
    rules = _migration_rules()
    flags = [f"_rule_{i}" for i in range(len(rules))]
    fired: list[tuple[_Rule, Column]] = []
    valid: Column = F.lit(True)
    for rule, flag in zip(rules, flags):
        broken = F.col(flag)
        fired.append((rule, (valid & broken) if rule.only_if_valid else broken))
        valid = valid & ~broken
    return df.withColumns({flag: rule.broken for rule, flag in zip(rules, flags)}), fired


def migration_failures(df: DataFrame) -> DataFrame:
    """One row per (record, broken rule) in firing order."""
    flagged, fired = _flagged(df)
    entries = [
        F.when(
            fires,
            F.struct(
                F.lit(rule.field).alias("failed_field"),
                F.lit(rule.name).alias("rule_violated"),
                F.col(rule.field).cast("string").alias("rejected_value"),
            ),
        )
        for rule, fires in fired
    ]
    return flagged.select(F.col("case_id").cast("string").alias("record_id"), F.inline(F.array(*entries))).where(
        F.col("failed_field").isNotNull()
    )


def migration_valid(df: DataFrame) -> DataFrame:
    """Rows that break no migration rule; a rule held back by an earlier one implies the earlier one."""
    return df.where(~reduce(lambda a, b: a | b, [rule.broken for rule in _migration_rules()]))


def reconcile(source: DataFrame, loaded: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of counts. ``match`` compares failure rows, ``records_match`` compares failed records."""
    counts = (
        source.agg(F.count(F.lit(1)).alias("source_count"))
        .crossJoin(loaded.agg(F.count(F.lit(1)).alias("loaded_count")))  # one row each
        .crossJoin(
            failures.agg(
                F.count(F.lit(1)).alias("quarantined_count"), F.count_distinct("record_id").alias("failed_records")
            )
        )
    )
    return counts.withColumn(
        "match", F.col("source_count") == F.col("loaded_count") + F.col("quarantined_count")
    )


def migration_report(source: DataFrame, min_success: float = MIN_SUCCESS_PCT) -> DataFrame:
    """One row: totals, success rate and status of a migration of ``source``, from one pass."""
    flagged, fired = _flagged(source)
    broken = F.col("_broken")
    row = flagged.withColumn("_broken", sum((fires.cast("int") for _, fires in fired), F.lit(0))).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(broken == 0).alias("success_count"),
        F.count_if(broken > 0).alias("failed_count"),
        F.coalesce(F.sum(broken), F.lit(0)).cast("long").alias("quarantined_count"),
    )
    rate = F.coalesce(share(F.col("success_count"), F.col("total_records")), F.lit(0.0))
    return row.select(
        "*",
        round_to(rate, 2).alias("success_rate"),
        F.when(rate >= min_success, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
    )


__all__ = [
    "check_contract",
    "clean",
    "coerce",
    "migration_failures",
    "migration_report",
    "migration_valid",
    "reconcile",
    "split_contract",
    "validate_contract",
]
