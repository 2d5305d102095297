"""Quality scores, violations and expectation checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casemill.functions.severity import null_severity, violation_severity
from casemill.operators import expectations, profiling, quality
from casemill.schema import CASE_COLUMNS
from casemill.workload.registry import query, rnd
from casemill.workload.tables import cases, table, with_cases

AS_OF = date(2000, 6, 30)
MIN_DATE = "1996-01-01"


def catalogs(spark, sf):
    """Allowed companies (nations of the first three regions) and channels (segments of rich customers)."""
    nations = table(spark, sf, "nation").where(F.col("n_regionkey") < 3).select(
        F.lit("company").alias("field"), F.col("n_name").alias("value")
    )
    brands = table(spark, sf, "part").where(F.col("p_retailprice") > 905).select(
        F.lit("cause").alias("field"), F.col("p_brand").alias("value")
    )
    return nations.unionByName(brands).distinct()


CATALOGS = """catalogs AS (SELECT 'company' AS field, n_name AS value FROM nation WHERE n_regionkey < 3
  UNION SELECT 'cause', p_brand FROM part WHERE p_retailprice > 905)"""
COUNTERS = f"""k AS (SELECT count(*) AS n, {", ".join(f"count({c}) AS has_{c}" for c in CASE_COLUMNS)},
  count(DISTINCT case_id) AS ids,
  count(*) FILTER (WHERE status NOT IN ('cerrado', 'en_proceso', 'abierto')) AS bad_status,
  count(*) FILTER (WHERE case_type NOT IN ('peticion', 'queja', 'reclamo')) AS bad_type,
  count(*) FILTER (WHERE handling_days < 0) AS bad_time,
  count(*) FILTER (WHERE status = 'cerrado' AND closed_on IS NULL) AS no_date,
  count(*) FILTER (WHERE outcome = 'accede' AND handling_days = 0) AS at_once,
  count(*) FILTER (WHERE closed_on < opened_on) AS early,
  count(*) FILTER (WHERE opened_on < DATE '1996-01-01' OR opened_on > DATE '2000-06-30') AS bad_date FROM cases)"""
MATCHES = """matches AS (SELECT field, value, EXISTS (SELECT 1 FROM catalogs c WHERE c.field = v.field AND c.value = v.value) AS ok
  FROM (SELECT 'company' AS field, company AS value FROM cases UNION ALL SELECT 'cause', cause FROM cases) v
  WHERE value IS NOT NULL)"""
DIM = {
    "completeness": rnd("(" + " + ".join(f"has_{c}" for c in CASE_COLUMNS) + ") * 100e0 / (n * 13)", 2),
    "validity": rnd("(n - bad_status + n - bad_type + has_handling_days - bad_time + has_opened_on) * 100e0 / (3 * n + has_handling_days)", 2),
    "consistency": rnd("greatest(100e0 - (no_date + at_once + early) * 100e0 / n, 0e0)", 2),
    "uniqueness": rnd("greatest(100e0 - " + rnd("(n - ids) * 100e0 / n", 2) + ", 0e0)", 2),
    "timeliness": rnd("greatest(100e0 - bad_date * 100e0 / n, 0e0)", 2),
    "referential_integrity": rnd(
        "greatest(100e0 - (SELECT count(*) FILTER (WHERE NOT ok) * 100e0 / count(*) FROM matches), 0e0)", 2
    ),
}
SCORE = rnd(
    "0e0 + completeness * 0.25e0 + validity * 0.20e0 + consistency * 0.20e0 + uniqueness * 0.15e0 + timeliness * 0.10e0"
    " + referential_integrity * 0.10e0",
    2,
)


def _register_dimension(number: int, name: str) -> None:
    @query(f"dq0{number}_{name}", with_cases(f"SELECT {DIM[name]} AS {name} FROM k", CATALOGS, MATCHES, COUNTERS))
    def run(spark, sf):
        listed = catalogs(spark, sf) if name == "referential_integrity" else None
        return getattr(quality, name)(cases(spark, sf), AS_OF, listed, MIN_DATE)


for _number, _name in enumerate(quality.DIMENSIONS, start=1):
    _register_dimension(_number, _name)


@query(
    "dq07_quality_score",
    with_cases(
        f"SELECT *, {SCORE} AS composite_score FROM (SELECT {', '.join(f'{v} AS {c}' for c, v in DIM.items())} FROM k)",
        CATALOGS,
        MATCHES,
        COUNTERS,
    ),
)
def quality_score(spark, sf):
    return quality.quality_score(cases(spark, sf), AS_OF, catalogs(spark, sf), MIN_DATE)


SEVERITY = """CASE WHEN pct > 20 THEN 'critical' WHEN pct > 10 THEN 'high' WHEN pct > 5 THEN 'medium' ELSE 'low' END"""
RULES_SQL = " UNION ALL ".join(
    [f"SELECT 'completeness_null_values' AS rule_name, '{c}' AS target_field, n - has_{c} AS bad, (n - has_{c}) * 100e0 / n AS pct FROM k" for c in CASE_COLUMNS]
    + [
        f"SELECT '{rule}', '{field}', {bad}, {bad} * 100e0 / n FROM k"
        for rule, field, bad in (
            ("validity_status_domain", "status", "bad_status"),
            ("validity_case_type_domain", "case_type", "bad_type"),
            ("validity_handling_days_range", "handling_days", "bad_time"),
            ("validity_opened_on_format", "opened_on", "(n - has_opened_on)"),
            ("consistency_closed_without_date", "status, closed_on", "no_date"),
            ("consistency_granted_at_zero_days", "outcome, handling_days", "at_once"),
            ("consistency_closed_before_opened", "closed_on, opened_on", "early"),
            ("uniqueness_duplicate_identifiers", "case_id", "(n - ids)"),
            ("timeliness_date_range", "opened_on", "bad_date"),
        )
    ]
    + [
        """SELECT 'referential_integrity_catalog_mismatch', field, count(*) FILTER (WHERE NOT ok),
        count(*) FILTER (WHERE NOT ok) * 100e0 / (SELECT n FROM k) FROM matches GROUP BY field"""
    ]
)


@query(
    "dq08_violations",
    with_cases(
        f"""SELECT rule_name, target_field, bad AS violations_count, {rnd("pct", 2)} AS violations_percentage,
        {SEVERITY} AS severity FROM ({RULES_SQL}) WHERE bad > 0""",
        CATALOGS,
        MATCHES,
        COUNTERS,
    ),
)
def violations(spark, sf):
    return quality.violations(cases(spark, sf), AS_OF, catalogs(spark, sf), MIN_DATE).drop("corrective_action")


@query(
    "dq09_violation_severity",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS pct, " + SEVERITY.replace("pct", "l_quantity") + " AS severity FROM lineitem",
)
def severity_of_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("pct"), violation_severity(F.col("l_quantity")).alias("severity")
    )


@query(
    "dq10_null_severity",
    with_cases(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, CASE WHEN pct > 20 THEN 'high' WHEN pct >= 5 THEN 'medium' ELSE 'low' END AS severity
            FROM (SELECT {rnd(f"(count(*) - count({c})) * 100e0 / count(*)", 2)} AS pct FROM cases)"""
            for c in CASE_COLUMNS
        )
    ),
)
def null_severities(spark, sf):
    stats = profiling.null_stats(cases(spark, sf))
    return stats.select("column_name", null_severity(F.col("null_percentage")).alias("severity"))


@query(
    "dq11_quick_score",
    with_cases(
        f"""SELECT *, {SCORE} AS composite_score FROM (SELECT {DIM["completeness"]} AS completeness, 100e0 AS validity,
          100e0 AS consistency, 100e0 - {rnd("(n - ids) * 100e0 / n", 2)} AS uniqueness, 100e0 AS timeliness,
          100e0 AS referential_integrity FROM k)""",
        COUNTERS,
    ),
)
def quick_score(spark, sf):
    return quality.quick_score(cases(spark, sf))


def _pct2(ratio: str) -> str:
    return f"round(({ratio}) * 10000e0) / 100e0"


REPORT_K = """k AS (SELECT count(*) AS n, count(cause) AS c1, count(company) AS c2, count(channel) AS c3, count(status) AS c4,
  count(opened_on) AS c5, count(*) FILTER (WHERE status = 'cerrado') AS nc,
  count(closed_on) FILTER (WHERE status = 'cerrado') AS cc, count(close_reason) FILTER (WHERE status = 'cerrado') AS cr,
  count(*) FILTER (WHERE handling_days < 0) AS neg,
  count(*) FILTER (WHERE status NOT IN ('cerrado', 'en_tramite', 'en_proceso', 'abierto')) AS bad,
  count(*) FILTER (WHERE opened_on > DATE '2000-06-30') AS fut,
  count(*) FILTER (WHERE (status = 'cerrado' AND closed_on IS NULL) OR closed_on < opened_on OR handling_days < 0) AS inc,
  count(*) FILTER (WHERE status = 'cerrado' AND closed_on IS NULL) AS nodate, count(*) FILTER (WHERE closed_on < opened_on) AS early,
  count(*) FILTER (WHERE opened_on >= (SELECT max(opened_on) - 365 FROM cases)) AS recent,
  count(*) FILTER (WHERE length(trim(company)) > 1) AS g1, count(*) FILTER (WHERE length(trim(channel)) > 1) AS g2,
  count(*) FILTER (WHERE length(trim(owner_unit)) > 1) AS g3, count(owner_unit) AS u FROM picked),
t AS (SELECT count(*) AS tuples FROM (SELECT DISTINCT cause, company, channel, status, outcome, opened_on, handling_days FROM picked))"""
PICKED = "picked AS (SELECT * FROM cases WHERE channel IN ('BUILDING', 'MACHINERY', 'FURNITURE'))"
REPORT_DIM = {
    "completeness": _pct2("(c1 / n + c2 / n + c3 / n + c4 / n + c5 / n + cc / nc + cr / nc) / 7"),
    "validity": _pct2("1e0 - (neg + bad + fut) / n"),
    "consistency": _pct2("1e0 - inc / n"),
    "uniqueness": _pct2("tuples / n"),
    "timeliness": _pct2("recent / n"),
    "domain_conformity": _pct2("(g1 / c2 + g2 / c3 + g3 / u) / 3"),
}
CHANNELS = ("BUILDING", "MACHINERY", "FURNITURE")


@query("dq12_conditional_completeness", with_cases(f"SELECT {REPORT_DIM['completeness']} AS completeness FROM k, t",
                                                   "picked AS (SELECT * FROM cases)", REPORT_K))
def conditional_completeness(spark, sf):
    return quality.conditional_completeness(cases(spark, sf), AS_OF)


@query(
    "dq13_quality_report",
    with_cases(
        f"""SELECT *, {rnd('''0e0 + completeness * 0.25e0 + validity * 0.20e0 + consistency * 0.20e0 + uniqueness * 0.15e0
          + timeliness * 0.10e0 + domain_conformity * 0.10e0''', 2)} AS overall_score
        FROM (SELECT n AS record_count, {', '.join(f'{v} AS {c}' for c, v in REPORT_DIM.items())} FROM k, t)""",
        PICKED,
        REPORT_K,
    ),
)
def quality_report(spark, sf):
    df = cases(spark, sf)
    return quality.quality_report(df.where(F.col("channel").isin(*CHANNELS)), AS_OF, cases(spark, sf, "opened_on"))


def _report_rule(rule: str, dimension: str, field: str, bad: str, whole: str, severity: str) -> str:
    return f"""SELECT '{rule}' AS rule_id, '{dimension}' AS dimension, '{field}' AS field, {bad} AS count,
      {_pct2(f"({bad}) / {whole}")} AS percentage, {severity.format(r=f"(({bad}) / {whole})")} AS severity FROM k, t"""


_LADDER = "CASE WHEN {r} > 0.1 THEN 'HIGH' WHEN {r} > 0.05 THEN 'MEDIUM' ELSE 'LOW' END"
REPORT_RULES_SQL = " UNION ALL ".join(
    _report_rule(*r)
    for r in (
        ("COMP-CAUSA", "completeness", "cause", "n - c1", "n", _LADDER),
        ("COMP-EMPRESA", "completeness", "company", "n - c2", "n", _LADDER),
        ("COMP-CANAL_ATENCION", "completeness", "channel", "n - c3", "n", _LADDER),
        ("COMP-ESTADO", "completeness", "status", "n - c4", "n", _LADDER),
        ("COMP-FECHA_CREACION", "completeness", "opened_on", "n - c5", "n", _LADDER),
        ("COMP-MOTIVO_CIERRE", "completeness", "close_reason", "nc - cr", "nc", "CASE WHEN {r} > 0.1 THEN 'HIGH' ELSE 'MEDIUM' END"),
        ("COMP-FECHA_CIERRE", "completeness", "closed_on", "nc - cc", "nc", "'HIGH'"),
        ("VAL-TIEMPO_NEG", "validity", "handling_days", "neg", "n", "'HIGH'"),
        ("VAL-ESTADO_INVALIDO", "validity", "status", "bad", "n", "'MEDIUM'"),
        ("CONS-CERRADO_SIN_CIERRE", "consistency", "closed_on", "nodate", "n", "CASE WHEN {r} > 0.05 THEN 'HIGH' ELSE 'MEDIUM' END"),
        ("CONS-CIERRE_ANTES_CREACION", "consistency", "closed_on, opened_on", "early", "n", "'HIGH'"),
        ("UNIQ-EXACT_DUPLICATES", "uniqueness", "(multiple)", "n - tuples", "n", "CASE WHEN {r} > 0.1 THEN 'HIGH' ELSE 'MEDIUM' END"),
    )
)


@query(
    "dq14_report_violations",
    with_cases(f"SELECT * FROM ({REPORT_RULES_SQL}) WHERE count > 0", "picked AS (SELECT * FROM cases)", REPORT_K),
)
def report_violations(spark, sf):
    return quality.report_violations(cases(spark, sf), AS_OF)


@query(
    "dq15_fallback_quality",
    with_cases(
        f"""SELECT *, {SCORE} AS composite_score FROM (SELECT count(*) AS record_count,
          {rnd("(" + " + ".join(rnd(f"count({c}) * 100e0 / count(*)", 2) for c in quality.FALLBACK_FIELDS) + ") / 4", 2)} AS completeness,
          85e0 AS validity, 80e0 AS consistency, 98e0 AS uniqueness, 90e0 AS timeliness, 85e0 AS referential_integrity FROM cases)"""
    ),
)
def fallback_quality(spark, sf):
    return quality.fallback_quality(cases(spark, sf, *quality.FALLBACK_FIELDS))


def _check(name: str, wanted: str, actual: str, within: str) -> str:
    return f"""SELECT '{name}' AS name, CAST({wanted} AS DOUBLE) AS expected, CAST({actual} AS DOUBLE) AS actual,
      {within.format(a=f"({actual})")} AS within, {rnd(f"CAST({actual} AS DOUBLE) - CAST({wanted} AS DOUBLE)", 2)} AS deviation FROM k, t"""


REF_K = f"""k AS (SELECT count(*) AS n, count(DISTINCT case_id) AS ids, avg(handling_days) AS mean,
    median(handling_days) AS med, quantile_cont(handling_days, 0.9) AS p90,
    count(*) FILTER (WHERE contains(lower(channel), 'telefon') OR contains(lower(channel), 'phone')) AS phone,
    count(*) FILTER (WHERE contains(lower(channel), 'verbal')) AS verbal,
    count(*) FILTER (WHERE close_reason IS NULL OR trim(close_reason) = '') AS no_reason,
    count(*) FILTER (WHERE marking IS NULL OR trim(marking) = '') AS no_marking,
    count(*) FILTER (WHERE company IS NULL OR company <> trim(company)) AS odd FROM cases),
  t AS (SELECT max(c) AS top, sum(c) FILTER (WHERE spellings > 1) AS dup FROM (SELECT cause, count(*) AS c,
    (SELECT count(DISTINCT p_brand) FROM part WHERE lower(trim(p_brand)) = lower(trim(cause))) AS spellings
    FROM cases WHERE cause IS NOT NULL GROUP BY cause))"""


def _pct(bad: str) -> str:
    return rnd(f"({bad}) * 100e0 / n", 2)


@query(
    "ref_checks",
    with_cases(
        " UNION ALL ".join(
            (
                _check("record_count", "51008", "n", "{a} BETWEEN 50497 AND 51518"),
                _check("column_count", "29", "13", "{a} BETWEEN 27 AND 31"),
                _check("duplication_rate", "1", _pct("n - ids"), "(n - ids) * 100e0 / n < 1"),
                _check("main_cause_share", "50", _pct("top"), "{a} BETWEEN 45 AND 55"),
                _check("handling_mean", "6.32e0", rnd("mean", 2), "{a} BETWEEN 5.82e0 AND 6.82e0"),
                _check("handling_median", "7", rnd("med", 2), "{a} BETWEEN 6 AND 8"),
                _check("handling_p90", "10", rnd("p90", 2), "{a} BETWEEN 9 AND 11"),
                _check("phone_verbal_share", "60", rnd(f"{_pct('phone')} + {_pct('verbal')}", 2), "{a} > 60"),
                _check("close_reason_missing", "NULL", _pct("no_reason"), "true"),
                _check("marking_missing", "NULL", _pct("no_marking"), "true"),
                _check("company_inconsistent", "NULL", _pct("odd"), "true"),
                _check("category_duplicated", "NULL", _pct("coalesce(dup, 0)"), "true"),
            )
        ),
        REF_K,
    ),
)
def reference_checks(spark, sf):
    return expectations.reference_checks(cases(spark, sf))


@query(
    "ref_summary",
    with_cases(
        """SELECT CAST(12 AS BIGINT) AS checks, passed, 12 - passed AS failed, passed = 12 AS all_passed
        FROM (SELECT CAST(4 + (n BETWEEN 50497 AND 51518)::INT + ((n - ids) * 100e0 / n < 1)::INT
          + (top * 100e0 / n BETWEEN 45 AND 55)::INT + (mean BETWEEN 5.82 AND 6.82)::INT + (med BETWEEN 6 AND 8)::INT
          + (p90 BETWEEN 9 AND 11)::INT + ((phone + verbal) * 100e0 / n > 60)::INT AS BIGINT) AS passed FROM k, t)""",
        REF_K,
    ),
)
def reference_summary(spark, sf):
    return expectations.check_summary(expectations.reference_checks(cases(spark, sf)))
