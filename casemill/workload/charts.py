"""Filters, KPIs, charts, Pareto tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions.numbers import coerce_number
from casemill.functions.text import PHONE_WORDS, VERBAL_WORDS, contains_any, is_blank
from casemill.operators import charts, filters, kpis, pareto
from casemill.operators.filters import CaseFilter
from casemill.workload.registry import query, rnd
from casemill.workload.tables import CASES, cases, table, with_cases

FILTER = CaseFilter(
    date_start="1996-01-01",
    date_end="2000-12-31",
    channels=("BUILDING", "MACHINERY", "AUTOMOBILE"),
    statuses=("cerrado", "abierto"),
    outcomes=("accede", "no_accede"),
    time_min=3,
    time_max=45,
)
FILTER_SQL = """opened_on >= DATE '1996-01-01' AND opened_on <= DATE '2000-12-31'
  AND channel IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND status IN ('cerrado', 'abierto')
  AND outcome IN ('accede', 'no_accede') AND handling_days >= 3 AND handling_days <= 45"""

GROUPS = """counts AS (SELECT cause, count(*) AS count FROM cases WHERE cause IS NOT NULL
  GROUP BY cause HAVING count(*) >= 5)"""
PARETO_SQL = f"""
SELECT cause, count, {rnd("count * 100e0 / (SELECT sum(count) FROM counts)", 2)} AS percentage,
  {rnd("sum(count) OVER (ORDER BY count DESC) * 100e0 / (SELECT sum(count) FROM counts)", 2)} AS cumulative_pct,
  row_number() OVER (ORDER BY count DESC, cause) = 1
    AND {rnd("count * 100e0 / (SELECT sum(count) FROM counts)", 2)} / 100 > 0.4 AS high_concentration,
  {rnd("count * 100e0 / (SELECT sum(count) FROM counts)", 2)} AS concentration_pct,
  'statistical_concentration' AS analysis_level
FROM counts"""


@query("src01_read_cases", with_cases("SELECT * FROM cases"))
def read_cases(spark, sf):
    return cases(spark, sf)


@query("flt01_filtered_cases", with_cases(f"SELECT * FROM cases WHERE {FILTER_SQL}"))
def filtered_cases(spark, sf):
    return filters.apply_filters(cases(spark, sf), FILTER)


@query(
    "flt04_filtered_count",
    with_cases(f"SELECT count(*) AS record_count, true AS filtered FROM cases WHERE {FILTER_SQL}"),
)
def filtered_count(spark, sf):
    df = cases(spark, sf, "opened_on", "channel", "status", "outcome", "handling_days")
    return filters.with_metadata(df, FILTER)


@query(
    "flt05_filter_options",
    with_cases(
        " UNION ".join(
            f"SELECT '{c}' AS dimension, {c} AS value FROM cases WHERE {c} IS NOT NULL"
            for c in ("company", "cause", "channel", "status", "outcome", "owner_unit")
        )
    ),
)
def filter_options(spark, sf):
    return filters.filter_options(cases(spark, sf, "company", "cause", "channel", "status", "outcome", "owner_unit"))


@query("flt05_filter_limits", with_cases("SELECT coalesce(max(handling_days), 0) AS handling_days_max FROM cases"))
def filter_limits(spark, sf):
    return filters.filter_limits(cases(spark, sf, "handling_days"))


@query(
    "flt06_coerced_numbers",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0e0) AS number,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0e0) AS junk FROM events""",
)
def coerced_numbers(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        coerce_number(F.get_json_object("props", "$.k")).alias("number"),
        coerce_number(F.col("event_type")).alias("junk"),
    )


@query(
    "flt07_keyword_rows",
    """SELECT conv_id, turn,
      (contains(lower(text), 'telefon') OR contains(lower(text), 'phone') OR contains(lower(text), 'telefonico')
        OR contains(lower(text), 'telefónico')) AS phone,
      contains(lower(text), 'verbal') AS verbal, contains(lower(text), 'cancel') AS cancel FROM conversations""",
)
def keyword_rows(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        contains_any(text, PHONE_WORDS).alias("phone"),
        contains_any(text, VERBAL_WORDS).alias("verbal"),
        contains_any(text, ("cancel",)).alias("cancel"),
    )


@query(
    "flt08_blank_documents",
    r"""SELECT doc_id, (text IS NULL OR length(regexp_replace(text, '^\s+|\s+$', '', 'g')) = 0) AS blank
    FROM documents""",
)
def blank_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", is_blank(F.col("text")).alias("blank"))


KPI_SQL = f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'cerrado') AS closed,
  count(*) FILTER (WHERE status = 'en_proceso') AS in_process,
  {rnd("count(*) FILTER (WHERE status = 'cerrado') * 100e0 / count(*)", 1)} AS percentage_closed,
  {rnd("avg(handling_days)", 1)} AS avg_handling, {rnd("median(handling_days)", 1)} AS median_handling,
  {rnd("quantile_cont(handling_days, 0.9)", 1)} AS p90_handling,
  {rnd("quantile_cont(handling_days, 0.95)", 1)} AS p95_handling,
  {rnd("max(handling_days)", 1)} AS max_handling, count(DISTINCT cause) AS distinct_causes"""


@query("agg01_kpis", with_cases(f"{KPI_SQL} FROM cases"))
def kpi_row(spark, sf):
    return kpis.kpis(cases(spark, sf, "status", "cause", "handling_days"))


@query("agg01_kpis_filtered", with_cases(f"{KPI_SQL} FROM cases WHERE {FILTER_SQL}"))
def kpi_row_filtered(spark, sf):
    df = cases(spark, sf, "opened_on", "channel", "status", "outcome", "cause", "handling_days")
    return kpis.kpis(filters.apply_filters(df, FILTER))


@query(
    "agg02_main_cause_share",
    with_cases(
        f"SELECT {rnd('max(count) * 100e0 / (SELECT count(*) FROM cases)', 1)} AS main_cause_share_pct FROM counts",
        GROUPS,
    ),
)
def main_cause_share(spark, sf):
    return kpis.main_cause_share(cases(spark, sf, "cause"))


@query(
    "agg03_quality_issue_pct",
    with_cases(
        "SELECT "
        + rnd(
            "count(*) FILTER (WHERE close_reason IS NULL OR marking IS NULL OR company IS NULL) * 100e0 / count(*)", 1
        )
        + " AS quality_issues_pct FROM cases"
    ),
)
def quality_issue_pct(spark, sf):
    return charts.quality_issue_pct(cases(spark, sf, "close_reason", "marking", "company"))


@query("agg04_pareto", with_cases(PARETO_SQL, GROUPS))
def pareto_causes(spark, sf):
    return pareto.pareto(cases(spark, sf, "cause"))


@query(
    "agg04_pareto_filtered_units",
    with_cases(
        PARETO_SQL.replace("cause", "owner_unit"),
        f"""counts AS (SELECT owner_unit, count(*) AS count FROM cases WHERE owner_unit IS NOT NULL AND {FILTER_SQL}
          GROUP BY owner_unit HAVING count(*) >= 5)""",
    ),
)
def pareto_filtered_units(spark, sf):
    df = cases(spark, sf, "opened_on", "channel", "status", "outcome", "owner_unit", "handling_days")
    return pareto.pareto(filters.apply_filters(df, FILTER), "owner_unit")


@query("agg05_top_causes", with_cases("SELECT cause, count FROM counts ORDER BY count DESC, cause LIMIT 10", GROUPS))
def top_causes(spark, sf):
    return charts.top_causes(cases(spark, sf, "cause"))


@query(
    "agg06_top_vs_rest",
    with_cases(
        f"""SELECT cause AS category, count, {rnd("count * 100e0 / total", 2)} AS percentage FROM top, total
        UNION ALL SELECT 'Otras causas', CAST(total - count AS BIGINT), {rnd("(total - count) * 100e0 / total", 2)}
        FROM top, total""",
        GROUPS,
        "top AS (SELECT * FROM counts ORDER BY count DESC, cause LIMIT 1)",
        "total AS (SELECT sum(count) AS total FROM counts)",
    ),
)
def top_vs_rest(spark, sf):
    return charts.top_vs_rest(cases(spark, sf, "cause"))


def _distribution_sql(column: str) -> str:
    return with_cases(
        f"""SELECT {column} AS category, count(*) AS count FROM cases WHERE {column} IS NOT NULL
        GROUP BY {column} HAVING count(*) >= 5"""
    )


@query("agg07_by_company", _distribution_sql("company"))
def by_company(spark, sf):
    return charts.distribution(cases(spark, sf, "company"), "company")


@query("agg08_by_channel", _distribution_sql("channel"))
def by_channel(spark, sf):
    return charts.distribution(cases(spark, sf, "channel"), "channel")


@query("agg09_by_outcome", _distribution_sql("outcome"))
def by_outcome(spark, sf):
    return charts.distribution(cases(spark, sf, "outcome"), "outcome")


@query(
    "agg10_monthly_trend",
    with_cases(
        """SELECT CAST(date_trunc('month', opened_on) AS DATE) AS period, count(*) AS count FROM cases
        GROUP BY 1 HAVING count(*) >= 5"""
    ),
)
def monthly_trend(spark, sf):
    return charts.monthly_trend(cases(spark, sf, "opened_on"))


@query(
    "agg10_monthly_trend_text",
    with_cases(
        "SELECT strftime(opened_on, '%Y-%m') AS period, count(*) AS count FROM cases GROUP BY 1 HAVING count(*) >= 5"
    ),
)
def monthly_trend_text(spark, sf):
    return charts.monthly_trend(cases(spark, sf, "opened_on"), text=True)


BOX = f"""{rnd("quantile_cont(handling_days, 0.25)", 2)} AS q1, {rnd("median(handling_days)", 2)} AS median,
  {rnd("quantile_cont(handling_days, 0.75)", 2)} AS q3, {rnd("min(handling_days)", 2)} AS whisker_low,
  {rnd("max(handling_days)", 2)} AS whisker_high"""


@query(
    "agg11_handling_box",
    with_cases(
        f"SELECT cases.cause, {BOX} FROM cases JOIN top ON cases.cause = top.cause GROUP BY cases.cause",
        GROUPS,
        "top AS (SELECT cause FROM counts ORDER BY count DESC, cause LIMIT 10)",
    ),
)
def handling_box(spark, sf):
    return charts.handling_box(cases(spark, sf, "cause", "handling_days"))


@query(
    "agg12_overall_box",
    with_cases(f"SELECT {BOX}, count(*) AS record_count FROM cases WHERE handling_days IS NOT NULL"),
)
def overall_box(spark, sf):
    return charts.overall_box(cases(spark, sf, "handling_days"))


@query(
    "agg13_p90_by_cause",
    with_cases(
        f"""SELECT cause, {rnd("quantile_cont(handling_days, 0.9)", 2)} AS p90, count(*) AS count FROM cases
        WHERE handling_days IS NOT NULL AND cause IS NOT NULL GROUP BY cause HAVING count(*) >= 5
        ORDER BY p90 DESC, cause LIMIT 10"""
    ),
)
def p90_by_cause(spark, sf):
    return charts.p90_by_cause(cases(spark, sf, "cause", "handling_days"))


CELLS = """cells AS (SELECT cause, channel, count(*) AS count FROM cases WHERE cause IS NOT NULL AND channel IS NOT NULL
  GROUP BY cause, channel HAVING count(*) >= 5)"""


@query("agg14_heatmap", with_cases("SELECT * FROM cells", CELLS))
def heatmap(spark, sf):
    return charts.heatmap(cases(spark, sf, "cause", "channel"))


@query(
    "agg15_open_age_histogram",
    with_cases(
        """SELECT CASE WHEN handling_days <= 7 THEN '0-7' WHEN handling_days <= 14 THEN '8-14'
          WHEN handling_days <= 21 THEN '15-21' WHEN handling_days <= 28 THEN '22-28'
          WHEN handling_days <= 60 THEN '29-60' ELSE '61+' END AS bucket, count(*) AS count
        FROM cases WHERE status <> 'cerrado' AND handling_days IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"""
    ),
)
def open_age_histogram(spark, sf):
    return charts.open_age_histogram(cases(spark, sf, "status", "handling_days"))


@query(
    "agg16_completeness_by_field",
    with_cases(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {rnd(f'count({c}) * 100e0 / count(*)', 2)} AS completeness_pct FROM cases"
            for c in charts.COMPLETENESS_FIELDS
        )
    ),
)
def completeness_by_field(spark, sf):
    return charts.completeness_by_field(cases(spark, sf, *charts.COMPLETENESS_FIELDS))


@query(
    "agg17_anomaly_matrix",
    with_cases(
        f"""SELECT cause, channel, count, {rnd("(count - mean) / nullif(std, 0)", 2)} AS z_score,
          coalesce(abs((count - mean) / nullif(std, 0)) > 2, false) AS is_anomaly FROM cells, spread""",
        CELLS,
        "spread AS (SELECT avg(count) AS mean, stddev_samp(count) AS std FROM cells)",
    ),
)
def anomaly_matrix(spark, sf):
    return charts.anomaly_matrix(cases(spark, sf, "cause", "channel"))


@query(
    "agg18_main_cause",
    with_cases(
        f"""SELECT cause, count, {rnd("count * 100e0 / (SELECT sum(count) FROM counts)", 2)} AS share_pct
        FROM counts ORDER BY count DESC, cause LIMIT 1""",
        GROUPS,
    ),
)
def main_cause(spark, sf):
    return kpis.main_cause(cases(spark, sf, "cause"))


@query(
    "agg19_suppressed_groups",
    """WITH g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS count FROM events GROUP BY 1, 2, 3)
    SELECT * FROM g WHERE count >= 5""",
)
def suppressed_groups(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    return charts.group_counts(events, "user_id", "event_type", "day")


ORDERED = """ranked AS (SELECT category, count, total,
    sum(count) OVER (ORDER BY count DESC, category ROWS UNBOUNDED PRECEDING) AS running,
    row_number() OVER (ORDER BY count DESC, category) AS position
  FROM (SELECT {c} AS category, count(*) AS count, (SELECT count({c}) FROM cases) AS total FROM cases
    WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= {m}))"""


@query(
    "win02_pareto_table",
    with_cases(
        f"""SELECT category, count, {rnd("count / total", 6)} AS proportion,
          {rnd("running / total", 6)} AS cumulative_proportion FROM ranked""",
        ORDERED.format(c="cause", m=1),
    ),
)
def pareto_table(spark, sf):
    return pareto.pareto_table(cases(spark, sf, "cause"))


@query(
    "win02_pareto_table_units",
    with_cases(
        f"""SELECT category, count, {rnd("count / total", 6)} AS proportion,
          {rnd("running / total", 6)} AS cumulative_proportion FROM ranked""",
        ORDERED.format(c="owner_unit", m=1),
    ),
)
def pareto_table_units(spark, sf):
    return pareto.pareto_table(cases(spark, sf, "owner_unit"), "owner_unit")


@query(
    "win03_pareto_core",
    with_cases(
        f"""SELECT category, count, {rnd("count / total", 4)} AS proportion,
          {rnd("running / total", 4)} AS cumulative_proportion
        FROM ranked WHERE (running - count) / total < 0.8 OR position = 1""",
        ORDERED.format(c="cause", m=1),
    ),
)
def pareto_core(spark, sf):
    return pareto.pareto_core(cases(spark, sf, "cause"))


EXECUTIVE = f"""SELECT position, category, count, {rnd("count * 100e0 / total", 2)} AS percentage,
    {rnd("running * 100e0 / total", 2)} AS cumulative_pct, position <= core_size AS in_core,
    CAST(1 AS BIGINT) AS grouped FROM shown
  UNION ALL
  SELECT max(position) + 1, 'Otras causas', CAST(max(total) - sum(count) AS BIGINT),
    {rnd("(max(total) - sum(count)) * 100e0 / max(total)", 2)}, 100e0, false,
    max(groups) - count(*) FROM shown HAVING count(*) < max(groups)"""
CORE = """core AS (SELECT count(*) FILTER (WHERE (running - count) / total < 0.8) AS core_size, count(*) AS groups
  FROM ranked)"""
SHOWN = "shown AS (SELECT * FROM ranked, core WHERE position <= least(core_size + 3, 10))"


@query("win04_executive_pareto", with_cases(EXECUTIVE, ORDERED.format(c="cause", m=1), CORE, SHOWN))
def executive_pareto(spark, sf):
    return pareto.executive_pareto(cases(spark, sf, "cause"), min_group=1)


@query(
    "win04_executive_pareto_channels", with_cases(EXECUTIVE, ORDERED.format(c="channel", m=1), CORE, SHOWN)
)
def executive_pareto_channels(spark, sf):
    return pareto.executive_pareto(cases(spark, sf, "channel"), "channel", min_group=1)


@query(
    "win06_top_companies",
    with_cases(
        """SELECT company AS category, count(*) AS count FROM cases WHERE company IS NOT NULL GROUP BY 1
        HAVING count(*) >= 5 ORDER BY count DESC, category LIMIT 7"""
    ),
)
def top_companies(spark, sf):
    return charts.top_k(
        charts.distribution(cases(spark, sf, "company"), "company"), [F.desc("count"), F.col("category")], 7
    )
