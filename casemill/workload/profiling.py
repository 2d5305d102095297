"""Profiling and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import profiling, statistics
from casemill.schema import CASE_COLUMNS
from casemill.workload.registry import query, rnd
from casemill.workload.tables import cases, table, with_cases


@query(
    "prf01_null_stats",
    with_cases(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,
            {rnd(f"(count(*) - count({c})) * 100e0 / count(*)", 2)} AS null_percentage,
            count(*) AS total_count FROM cases"""
            for c in CASE_COLUMNS
        )
    ),
)
def null_stats(spark, sf):
    return profiling.null_stats(cases(spark, sf))


@query(
    "prf02_duplicate_report",
    f"""SELECT count(*) AS total_records, count(DISTINCT l_orderkey) AS distinct_identifiers,
      count(*) - count(DISTINCT l_orderkey) AS duplicate_count,
      {rnd("(count(*) - count(DISTINCT l_orderkey)) * 100e0 / count(*)", 2)} AS duplication_rate,
      (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS repeated_identifiers
    FROM lineitem""",
)
def duplicate_report(spark, sf):
    return profiling.duplicate_report(cases(spark, sf, "case_id"))


@query(
    "prf02_duplicate_ids",
    "SELECT l_orderkey AS case_id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark, sf):
    return profiling.duplicate_ids(cases(spark, sf, "case_id"))


def _outlier_sql(source: str, value: str, by: str | None) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else "CROSS JOIN q"
    outside = f"{value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)"
    hits = f"count(*) FILTER (WHERE q3 <> q1 AND ({outside}))"
    return f"""WITH q AS (SELECT {keys} quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3
      FROM {source} {group})
    SELECT {keys} {rnd("any_value(q1)", 4)} AS q1, {rnd("any_value(q3)", 4)} AS q3,
      {rnd("any_value(q3 - q1)", 4)} AS iqr, {hits} AS outlier_count, count({value}) AS total_count,
      {rnd(f"{hits} * 100e0 / count({value})", 2)} AS outlier_percentage
    FROM {source} {join} {group}"""


def _rounded(df):
    return df.drop("lower_bound", "upper_bound").withColumns(
        {c: F.round(F.col(c) * F.lit(10000.0)) / F.lit(10000.0) for c in ("q1", "q3", "iqr")}
    )


@query("prf03_iqr_outliers_price", _outlier_sql("lineitem", "l_extendedprice", None))
def iqr_outliers_price(spark, sf):
    return _rounded(statistics.iqr_outliers(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("prf03_iqr_outliers_by_event", _outlier_sql("events", "value", "event_type"))
def iqr_outliers_by_event(spark, sf):
    return _rounded(statistics.iqr_outliers(table(spark, sf, "events"), "value", ("event_type",)))


_SHAPES_SQL = " OR ".join(f"regexp_matches(s, '{p}')" for p in profiling.DATE_SHAPES)
_KIND_SQL = f"""CASE WHEN s = '' THEN NULL
  WHEN lower(s) IN ({", ".join(f"'{w}'" for w in profiling.BOOLEAN_WORDS)}) THEN 'boolean'
  WHEN regexp_matches(replace(s, ',', '.'), '{profiling.NUMBER_SHAPE}') THEN 'numeric'
  WHEN {_SHAPES_SQL} THEN 'datetime' ELSE 'string' END"""


def _text_table(spark, sf):
    """Text columns of every semantic type, from whole tables."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("date_text"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" Si ")).otherwise(F.lit("no")).alias("flag_text"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("12,5")).otherwise(F.concat(F.lit("v"), F.col("o_orderkey"))).alias(
            "mixed_text"
        ),
        F.when(F.col("o_orderkey") < 0, F.lit("x")).otherwise(F.lit("  ")).alias("blank_text"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("day"),
    )


_TEXT_SQL = """text_cols AS (SELECT CAST(o_orderkey AS VARCHAR) AS key_text,
    strftime(o_orderdate, '%d/%m/%Y') AS date_text,
    CASE WHEN o_orderstatus = 'F' THEN ' Si ' ELSE 'no' END AS flag_text, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 3 = 0 THEN '12,5' ELSE 'v' || o_orderkey END AS mixed_text, '  ' AS blank_text FROM orders)"""


def _types_sql() -> str:
    parts = []
    for c in ("key_text", "date_text", "flag_text", "priority", "mixed_text", "blank_text"):
        parts.append(
            f"""SELECT '{c}' AS column_name, {_KIND_SQL} AS kind, {c} AS value
            FROM (SELECT {c}, regexp_replace({c}, '^\\s+|\\s+$', '', 'g') AS s FROM text_cols)"""
        )
    pct = {
        k: rnd(f"count(*) FILTER (WHERE kind = '{k}') * 100e0 / nullif(count(kind), 0)", 2)
        for k in ("boolean", "numeric", "datetime", "string")
    }
    best = "greatest(" + ", ".join(f"coalesce({p}, 0e0)" for p in pct.values()) + ")"
    native = """SELECT 'price' AS column_name, 'numeric' AS inferred_type, 100e0 AS confidence,
        count(DISTINCT o_totalprice) AS distinct_count, 0e0 AS boolean_pct, 100e0 AS numeric_pct,
        0e0 AS datetime_pct, 0e0 AS string_pct FROM orders
      UNION ALL SELECT 'day', 'datetime', 100e0, count(DISTINCT o_orderdate), 0e0, 0e0, 100e0, 0e0 FROM orders"""
    leader = f"""CASE WHEN count(kind) = 0 THEN 'unknown' WHEN {best} < 80 THEN 'mixed'
      WHEN {pct['boolean']} >= 80 THEN 'boolean' WHEN {pct['numeric']} >= 80 THEN 'numeric'
      WHEN {pct['datetime']} >= 80 THEN 'datetime'
      WHEN count(DISTINCT value) < 50 THEN 'categorical' ELSE 'text' END"""
    return f"""WITH {_TEXT_SQL}, k AS ({" UNION ALL ".join(parts)})
    SELECT column_name, {leader} AS inferred_type, {best} AS confidence, count(DISTINCT value) AS distinct_count,
      {", ".join(f"coalesce({p}, 0e0) AS {k}_pct" for k, p in pct.items())}
    FROM k GROUP BY column_name UNION ALL {native}"""


@query("prf04_infer_types", _types_sql())
def infer_types(spark, sf):
    return profiling.infer_types(_text_table(spark, sf))


def _dates_table(spark, sf):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    patterns = ("yyyy-MM-dd", "dd/MM/yyyy HH:mm", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy HH:mm:ss")
    text = F.lit("not a date")
    for i, p in enumerate(patterns):
        text = F.when(key % 7 == i, F.date_format(day, p)).otherwise(text)
    return table(spark, sf, "orders").select(F.when(key % 7 == 6, F.lit("31/02/2020")).otherwise(text).alias("day_text"))


@query(
    "prf05_validate_dates",
    f"""WITH t AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
        WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y %H:%M:%S')
        WHEN 6 THEN '31/02/2020' ELSE 'not a date' END AS s FROM orders),
      f AS (SELECT s, CASE {" ".join(f"WHEN try_strptime(s, '{f}') IS NOT NULL THEN '{f}'" for f in profiling.DATE_FORMATS)}
        END AS fmt FROM t)
    SELECT 'day_text' AS column_name, count(*) AS total_count, count(fmt) AS valid_count,
      count(*) - count(fmt) AS invalid_count,
      {rnd("(count(*) - count(fmt)) * 100e0 / count(*)", 2)} AS invalid_percentage,
      (SELECT string_agg(fmt, '|' ORDER BY fmt) FROM (SELECT DISTINCT fmt FROM f WHERE fmt IS NOT NULL)) AS recognized_formats,
      (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT s FROM f WHERE fmt IS NULL ORDER BY s LIMIT 10))
        AS sample_invalid_values
    FROM f""",
)
def validate_dates(spark, sf):
    report = profiling.validate_dates(_dates_table(spark, sf), "day_text")
    return report.withColumns(
        {c: F.array_join(c, "|") for c in ("recognized_formats", "sample_invalid_values")}
    )


@query(
    "prf06_similar_values",
    f"""WITH RECURSIVE names AS (SELECT DISTINCT p_brand AS value, lower(p_brand) AS v FROM part),
      edges AS (SELECT x.v AS a, y.v AS b FROM names x, names y WHERE x.v <> y.v
        AND 1 - levenshtein(x.v, y.v) / CAST(greatest(length(x.v), length(y.v)) AS DOUBLE) >= 0.85),
      reach(node, root) AS (SELECT v, v FROM names UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
      comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
      members AS (SELECT component, value, v FROM names JOIN comp ON node = v),
      score AS (SELECT x.component, avg(1 - levenshtein(x.v, y.v) / CAST(greatest(length(x.v), length(y.v)) AS DOUBLE))
        AS score FROM members x JOIN members y ON x.component = y.component AND x.value < y.value GROUP BY x.component)
    SELECT component, value, {rnd("score", 4)} AS similarity_score FROM members JOIN score USING (component)""",
)
def similar_values(spark, sf):
    return profiling.similar_values(table(spark, sf, "part"), "p_brand")


def _profile_sql() -> str:
    kinds = {"case_id": "numeric", "handling_days": "numeric", "opened_on": "datetime", "closed_on": "datetime"}
    parts = []
    for c in CASE_COLUMNS:
        kind = f"'{kinds[c]}'" if c in kinds else f"CASE WHEN count(DISTINCT {c}) < 50 THEN 'categorical' ELSE 'text' END"
        hits = "CAST(0 AS BIGINT)"
        if kinds.get(c) == "numeric":
            hits = f"""(SELECT count(*) FROM cases, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM cases)
              WHERE q3 <> q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))"""
        pct = f"(count(*) - count({c})) * 100e0 / count(*)"
        parts.append(
            f"""SELECT '{c}' AS column_name, {kind} AS data_type, count(*) - count({c}) AS null_count, {rnd(pct, 2)} AS null_percentage,
            count(DISTINCT {c}) AS unique_count, {hits} AS outlier_count, CAST(0 AS BIGINT) AS invalid_date_count,
            CASE WHEN {pct} > 20 THEN 'high' WHEN {pct} >= 5 THEN 'medium' ELSE 'low' END AS severity FROM cases"""
        )
    return with_cases(" UNION ALL ".join(parts))


@query("prf07_profile_columns", _profile_sql())
def profile_columns(spark, sf):
    return profiling.profile_columns(cases(spark, sf)).drop("similar_groups")


@query("prf07_similar_groups")
def similar_groups(spark, sf):
    return profiling.profile_columns(cases(spark, sf)).select("column_name", "similar_groups")


@query(
    "prf08_dataset_metrics",
    with_cases(
        f"""SELECT count(*) AS total_record_count, CAST(13 AS BIGINT) AS total_column_count,
          {rnd("(" + " + ".join(f"count({c})" for c in CASE_COLUMNS) + ") * 100e0 / (count(*) * 13)", 2)}
            AS overall_completeness_pct,
          100e0 AS overall_validity_pct,
          {rnd("(count(*) - count(DISTINCT case_id)) * 100e0 / count(*)", 2)} AS duplication_rate FROM cases"""
    ),
)
def dataset_metrics(spark, sf):
    return profiling.dataset_metrics(cases(spark, sf))


def _describe_sql(source: str, value: str, by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else "CROSS JOIN q"
    having = "HAVING count(*) >= 5" if by else ""

    def q(p: float) -> str:
        return rnd(f"quantile_cont({value}, {p})", 2)

    hits = f"""count(*) FILTER (WHERE q3 <> q1 AND ({value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)))"""
    return f"""WITH q AS (SELECT {keys} quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3
      FROM {source} {group}),
      m AS (SELECT {keys} {value} AS mode_value, row_number() OVER ({f"PARTITION BY {by}" if by else ""}
        ORDER BY count(*) DESC, {value}) AS place FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys} {value})
    SELECT {keys} count({value}) AS count, {rnd(f"avg({value})", 2)} AS mean, {q(0.5)} AS median,
      {rnd("any_value(mode_value)", 2)} AS mode, {rnd(f"var_samp({value})", 2)} AS variance,
      {rnd(f"stddev_samp({value})", 2)} AS std, {rnd(f"max({value})", 2)} AS max, {q(0.25)} AS q1, {q(0.5)} AS q2,
      {q(0.75)} AS q3, {q(0.9)} AS p90, {q(0.95)} AS p95, {rnd(f"{q(0.75)} - {q(0.25)}", 2)} AS iqr,
      {hits} AS outlier_count, {rnd(f"{hits} * 100e0 / count({value})", 2)} AS outlier_percentage
    FROM {source} {join} {"JOIN" if by else "CROSS JOIN"} (SELECT * FROM m WHERE place = 1) {f"USING ({by})" if by else ""}
    {group} {having}"""


@query("sta01_describe_price", _describe_sql("lineitem", "l_extendedprice"))
def describe_price(spark, sf):
    return statistics.describe_numeric(table(spark, sf, "lineitem"), "l_extendedprice")


@query("sta02_describe_by_event", _describe_sql("events", "value", "event_type"))
def describe_by_event(spark, sf):
    return statistics.describe_by(table(spark, sf, "events"), "value", "event_type")


@query(
    "sta03_conditional_probability",
    with_cases(
        f"""SELECT marking AS group_value, {rnd("count(*) FILTER (WHERE outcome = 'accede') / count(outcome)", 4)} AS probability,
          count(outcome) AS sample_size, count(outcome) < 30 AS is_low_confidence,
          (SELECT count(*) FROM cases WHERE marking IS NULL) AS excluded_null_count
        FROM cases WHERE marking IS NOT NULL GROUP BY marking"""
    ),
)
def conditional_probability(spark, sf):
    return statistics.conditional_probability(cases(spark, sf, "marking", "outcome"), F.col("outcome") == "accede", "marking")


Z = "1.959963984540054e0"


@query(
    "sta04_wilson_interval",
    with_cases(
        f"""SELECT cause, hits, total,
          {rnd(f"greatest(0e0, (p + {Z} * {Z} / (2e0 * n) - {Z} * sqrt((p * (1 - p) + {Z} * {Z} / (4e0 * n)) / n)) / (1 + {Z} * {Z} / n))", 6)} AS lower,
          {rnd(f"least(1e0, (p + {Z} * {Z} / (2e0 * n) + {Z} * sqrt((p * (1 - p) + {Z} * {Z} / (4e0 * n)) / n)) / (1 + {Z} * {Z} / n))", 6)} AS upper
        FROM (SELECT *, hits / total AS p, CAST(total AS DOUBLE) AS n FROM (SELECT cause,
          count(*) FILTER (WHERE status = 'cerrado') AS hits, count(*) AS total FROM cases GROUP BY cause))"""
    ),
)
def wilson_interval(spark, sf):
    grouped = cases(spark, sf, "cause", "status").groupBy("cause").agg(
        F.count_if(F.col("status") == "cerrado").alias("hits"), F.count(F.lit(1)).alias("total")
    )
    return statistics.wilson_interval(grouped, "hits", "total", places=6)


CHI_SQL = """o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM cases WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT a, sum(o) AS r FROM o GROUP BY a), c AS (SELECT b, sum(o) AS c FROM o GROUP BY b),
  n AS (SELECT CAST(sum(o) AS DOUBLE) AS n FROM o),
  grid AS (SELECT coalesce(o.o, 0) AS o, r.r * CAST(c.c AS DOUBLE) / n AS e FROM r CROSS JOIN c CROSS JOIN n
    LEFT JOIN o ON o.a = r.a AND o.b = c.b)"""


def _chi_sql(a: str, b: str, yates: bool) -> str:
    gap = "(abs(o - e) - least(0.5, abs(o - e)))" if yates else "(o - e)"
    return with_cases(
        f"""SELECT {rnd(f"sum({gap} * {gap} / e)", 4)} AS statistic,
        ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS degrees_of_freedom,
        (SELECT CAST(n AS BIGINT) FROM n) AS sample_size FROM grid""",
        CHI_SQL.format(a=a, b=b),
    )


@query("sta05_chi_square_statistic", _chi_sql("cause", "channel", False))
def chi_square_statistic(spark, sf):
    raw = statistics.chi_square_statistic(cases(spark, sf, "cause", "channel"), "cause", "channel")
    return raw.withColumn("statistic", F.round(F.col("statistic") * 10000.0) / 10000.0)


@query("sta05_chi_square_2x2", _chi_sql("outcome", "closed", True).replace(
    "closed AS b, count(*) AS o FROM cases", "status = 'cerrado' AS b, count(*) AS o FROM cases").replace(
    "AND closed IS NOT NULL", "AND status IS NOT NULL"))
def chi_square_2x2(spark, sf):
    df = cases(spark, sf, "outcome", "status").withColumn("closed", F.col("status") == "cerrado")
    raw = statistics.chi_square_statistic(df, "outcome", "closed")
    return raw.withColumn("statistic", F.round(F.col("statistic") * 10000.0) / 10000.0)


@query("sta05_chi_square")
def chi_square(spark, sf):
    return statistics.chi_square(cases(spark, sf, "cause", "channel"), "cause", "channel")


@query("sta06_two_proportion_z")
def two_proportion_z(spark, sf):
    df = cases(spark, sf, "outcome", "channel")
    return statistics.two_proportion_z(df, "channel", "BUILDING", "MACHINERY", F.col("outcome") == "accede")


@query(
    "sta06_two_proportion_statistic",
    with_cases(
        f"""SELECT n1, n2, {rnd("(k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1e0 / n1 + 1e0 / n2))", 4)} AS statistic
        FROM (SELECT count(outcome) FILTER (WHERE channel = 'BUILDING') AS n1,
          count(outcome) FILTER (WHERE channel = 'MACHINERY') AS n2,
          count(*) FILTER (WHERE channel = 'BUILDING' AND outcome = 'accede') AS k1,
          count(*) FILTER (WHERE channel = 'MACHINERY' AND outcome = 'accede') AS k2 FROM cases)"""
    ),
)
def two_proportion_statistic(spark, sf):
    return two_proportion_z(spark, sf).select("n1", "n2", "statistic")


@query("sta07_shapiro_wilk")
def shapiro_wilk(spark, sf):
    return statistics.shapiro_wilk(table(spark, sf, "events"), "value")


@query("sta08_shapiro_by")
def shapiro_by(spark, sf):
    return statistics.shapiro_by(table(spark, sf, "events"), "value", "event_type")


@query("sta09_mean_ci")
def mean_ci(spark, sf):
    return statistics.mean_ci(cases(spark, sf, "handling_days"), "handling_days")


@query(
    "sta10_mean_ci_by",
)
def mean_ci_by(spark, sf):
    return statistics.mean_ci_by(cases(spark, sf, "cause", "handling_days"), "handling_days", "cause")


@query(
    "sta10_mean_and_error",
    with_cases(
        f"""SELECT cause, {rnd("avg(handling_days)", 2)} AS mean, 0.95e0 AS confidence_level,
        {rnd("stddev_samp(handling_days) / sqrt(count(handling_days))", 4)} AS std_error,
        count(handling_days) AS sample_size FROM cases WHERE cause IS NOT NULL GROUP BY cause HAVING count(handling_days) >= 5"""
    ),
)
def mean_and_error(spark, sf):
    return mean_ci_by(spark, sf).drop("lower", "upper")
