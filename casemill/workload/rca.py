"""Root-cause analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import rca
from casemill.workload.registry import query, rnd
from casemill.workload.tables import cases, table, with_cases

CAUSE = "Brand#2"
MAIN = """g AS (SELECT cause, count(*) AS c FROM cases WHERE cause IS NOT NULL GROUP BY cause),
  m AS (SELECT cause, c, (SELECT sum(c) FROM g) AS total FROM g ORDER BY c DESC, cause LIMIT 1)"""
MONTHS = f"""mo AS (SELECT strftime(opened_on, '%Y-%m') AS month, count(*) AS count FROM cases
  WHERE cause = '{CAUSE}' AND opened_on IS NOT NULL GROUP BY 1)"""


@query(
    "rca01_identify_main_cause",
    with_cases(
        f"""SELECT cause AS cause_name, c AS record_count, {rnd("c / total", 6)} AS percentage_share,
          c / total >= 0.45 AS is_confirmed,
          'main cause ' || cause || CASE WHEN c / total >= 0.45 THEN ' confirmed' ELSE ' not confirmed' END || ' with ' || c
            || ' of ' || CAST(total AS BIGINT) || ' records' AS validation_message FROM m""",
        MAIN,
    ),
)
def identify_main_cause(spark, sf):
    return rca.identify_main_cause(cases(spark, sf, "cause"))


@query(
    "rca02_cause_summary",
    with_cases(
        f"""SELECT '{CAUSE}' AS cause_name, count(*) FILTER (WHERE cause = '{CAUSE}') AS absolute_volume,
        {rnd(f"count(*) FILTER (WHERE cause = '{CAUSE}') / count(cause)", 6)} AS percentage_share FROM cases"""
    ),
)
def cause_summary(spark, sf):
    return rca.cause_summary(cases(spark, sf, "cause"), CAUSE)


@query("rca03_cause_trend", with_cases("SELECT * FROM mo", MONTHS))
def cause_trend(spark, sf):
    return rca.cause_trend(cases(spark, sf, "cause", "opened_on"), CAUSE)


def _share_sql(column: str, scale: str, places: int, name: str) -> str:
    return with_cases(
        f"""SELECT {column}, count(*) AS count, {rnd(f"count(*) * {scale} / sum(count(*)) OVER ()", places)} AS {name}
        FROM cases WHERE cause = '{CAUSE}' AND {column} IS NOT NULL GROUP BY {column}"""
    )


@query("rca04_cause_channels", _share_sql("channel", "1e0", 4, "proportion"))
def cause_channels(spark, sf):
    return rca.cause_channels(cases(spark, sf, "cause", "channel"), CAUSE)


@query(
    "rca05_cause_time_stats",
    with_cases(
        f"""SELECT {rnd("avg(handling_days)", 2)} AS mean, {rnd("median(handling_days)", 2)} AS median,
        {rnd("quantile_cont(handling_days, 0.9)", 2)} AS p90 FROM cases WHERE cause = '{CAUSE}'"""
    ),
)
def cause_time_stats(spark, sf):
    return rca.cause_time_stats(cases(spark, sf, "cause", "handling_days"), CAUSE)


@query("rca06_cause_outcomes", _share_sql("outcome", "100e0", 2, "percentage"))
def cause_outcomes(spark, sf):
    return rca.cause_outcomes(cases(spark, sf, "cause", "outcome"), CAUSE)


@query(
    "rca07_related_causes",
    with_cases(
        f"""SELECT cause, c AS count, {rnd("c / (SELECT sum(c) FROM g)", 6)} AS share,
          {rnd("(SELECT sum(c) FROM g WHERE contains(lower(cause), '#1') OR contains(lower(cause), '#2')) / (SELECT sum(c) FROM g)", 6)}
            AS combined_share
        FROM g WHERE (contains(lower(cause), '#1') OR contains(lower(cause), '#2')) AND cause <> '{CAUSE}'""",
        MAIN,
    ),
)
def related_causes(spark, sf):
    return rca.related_causes(cases(spark, sf, "cause"), CAUSE, words=("#1", "#2"))


@query(
    "rca08_operational_impact",
    with_cases(f"SELECT {rnd('avg(count) * 15e0 / 60e0', 2)} AS hours_per_month FROM mo", MONTHS),
)
def operational_impact(spark, sf):
    return rca.operational_impact(cases(spark, sf, "cause", "opened_on"), CAUSE)


def _modes(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("mode_id"),
        F.col("p_name").alias("mode"),
        (F.col("p_size") % 5 + 1).alias("severity"),
        (F.col("p_partkey") % 5 + 1).alias("occurrence"),
        (F.length("p_type") % 5 + 1).alias("detection"),
    )


MODES = """modes AS (SELECT p_partkey AS mode_id, p_name AS mode,
  (p_size % 5 + 1) * (p_partkey % 5 + 1) * (length(p_type) % 5 + 1) AS rpn FROM part)"""


@query("rca10_failure_modes", f"WITH {MODES} SELECT mode_id, mode, CAST(rpn AS BIGINT) AS rpn FROM modes")
def failure_modes(spark, sf):
    return rca.failure_modes(_modes(spark, sf)).select("mode_id", "mode", F.col("rpn").cast("long").alias("rpn"))


@query(
    "rca10_fmea",
    f"""WITH {MODES}, top AS (SELECT * FROM modes ORDER BY rpn DESC, mode_id LIMIT 1)
    SELECT CAST(sum(modes.rpn) AS BIGINT) AS total_rpn, {rnd("avg(modes.rpn)", 2)} AS average_rpn,
      any_value(top.mode) AS highest_mode, CAST(any_value(top.rpn) AS BIGINT) AS highest_rpn FROM modes, top""",
)
def fmea(spark, sf):
    return rca.fmea(_modes(spark, sf), order="mode_id")


@query(
    "rca11_automation_opportunity",
    with_cases(
        f"""SELECT n AS records, {rnd("monthly", 4)} AS monthly_volume, 65e0 AS eliminable_manual_pct, 2.5e0 AS time_reduction_days,
          CAST(floor(monthly * 0.65e0) AS BIGINT) AS stp_monthly_volume, {rnd("mean", 1)} AS avg_days
        FROM (SELECT count(*) AS n, avg(handling_days) AS mean,
          count(*) / greatest(date_diff('day', min(opened_on), max(opened_on)) / 30.44e0, 1e0) AS monthly
          FROM cases WHERE cause = '{CAUSE}')"""
    ),
)
def automation_opportunity(spark, sf):
    return rca.automation_opportunity(cases(spark, sf, "cause", "opened_on", "handling_days"), CAUSE)


@query(
    "agg20_findings",
    with_cases(
        f"""SELECT cause || ' is the main cause with ' || {rnd(rnd("c / total", 6) + " * 100", 1)} || '% of cases' AS description,
          'total_cases' AS affected_metric, CASE WHEN c / total >= 0.45 THEN 'high' ELSE 'medium' END AS severity,
          'Improve the process behind ' || cause AS recommended_action FROM m
        UNION ALL SELECT 'Mean handling time ' || {rnd("avg(handling_days)", 1)} || ' days, 90th percentile '
          || {rnd("quantile_cont(handling_days, 0.9)", 1)} || ' days', 'avg_handling_days', 'medium', 'Shorten the workflow'
        FROM cases WHERE cause = (SELECT cause FROM m)""",
        MAIN,
    ),
)
def findings(spark, sf):
    return rca.findings(cases(spark, sf, "cause", "handling_days"))
