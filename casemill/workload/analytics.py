"""Risk model, backlog, productivity, control charts, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import backlog, control, risk
from casemill.workload.registry import query, rnd
from casemill.workload.tables import cases, table, with_cases

RISK_COLUMNS = (*risk.FEATURES, "handling_days")


@query(
    "ml01_label_p90",
    with_cases(
        """SELECT case_id, handling_days, threshold, CAST(handling_days > threshold AS INTEGER) AS label FROM cases,
        (SELECT quantile_cont(handling_days, 0.9) AS threshold FROM cases) WHERE handling_days IS NOT NULL"""
    ),
)
def label_p90(spark, sf):
    return risk.label_p90(cases(spark, sf, "case_id", "handling_days"))


@query(
    "ml02_prepare_features",
    with_cases(
        f"SELECT {', '.join(f'''coalesce({c}, 'desconocido') AS {c}''' for c in risk.FEATURES)} FROM cases"
    ),
)
def prepare_features(spark, sf):
    return risk.prepare_features(cases(spark, sf, *risk.FEATURES))


@query(
    "ml03_stratified_split",
    with_cases(
        """SELECT label, CAST(round(n * 0.25) AS BIGINT) AS test_rows, n - CAST(round(n * 0.25) AS BIGINT) AS train_rows FROM (
        SELECT CAST(handling_days > (SELECT quantile_cont(handling_days, 0.9) FROM cases) AS INTEGER) AS label, count(*) AS n FROM cases GROUP BY 1)"""
    ),
)
def stratified_split(spark, sf):
    tuples = risk.fold(risk.prepare_features(risk.label_p90(cases(spark, sf, *RISK_COLUMNS))))
    side = F.when(F.col("is_test"), F.col("n")).otherwise(F.lit(0.0))
    return risk.stratified_split(tuples).groupBy("label").agg(
        F.sum(side).cast("long").alias("test_rows"), F.sum(F.col("n") - side).cast("long").alias("train_rows")
    )


@query(
    "ml04_class_balance",
    with_cases(
        f"""SELECT label, count(*) AS count, {rnd("count(*) / sum(count(*)) OVER ()", 4)} AS share,
          min(count(*)) OVER () / sum(count(*)) OVER () < 0.2 AS is_imbalanced FROM (
        SELECT CAST(handling_days > (SELECT quantile_cont(handling_days, 0.9) FROM cases) AS INTEGER) AS label FROM cases) GROUP BY label"""
    ),
)
def class_balance(spark, sf):
    return risk.class_balance(risk.label_p90(cases(spark, sf, "handling_days")))


@query("ml05_risk_report")
def risk_report(spark, sf):
    return risk.risk_report(cases(spark, sf, *RISK_COLUMNS))


@query(
    "ml07_evaluate",
    f"""WITH s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST(l_discount > 0.05e0 AS INTEGER) AS prediction, l_discount AS score FROM lineitem),
      c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM s),
      g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY score),
      a AS (SELECT sum(pos * (below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM g))
    SELECT {rnd("tp / (tp + fp)", 4)} AS precision, {rnd("tp / (tp + fn)", 4)} AS recall, {rnd("2 * tp / (2 * tp + fp + fn)", 4)} AS f1_score,
      {rnd("auc", 4)} AS roc_auc, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive FROM c, a""",
)
def evaluate(spark, sf):
    scored = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") > 0.05).cast("int").alias("prediction"),
        F.col("l_discount").alias("score"),
        F.lit(1.0).alias("n"),
    )
    return risk.evaluate(scored)


@query("ml08_feature_importance")
def feature_importance(spark, sf):
    return risk.feature_importance(risk.train_risk(cases(spark, sf, *RISK_COLUMNS)), spark)


AS_OF = "2001-06-30"
OPEN = """open AS (SELECT *, date_diff('day', opened_on, DATE '2001-06-30') AS days_open,
  date_diff('day', opened_on, DATE '2001-06-30') > 900 AS is_overdue, 900 - date_diff('day', opened_on, DATE '2001-06-30') AS days_to_breach
  FROM cases WHERE status <> 'cerrado' AND opened_on <= DATE '2001-06-30')"""


def _open(spark, sf, *extra):
    return backlog.open_cases(cases(spark, sf, "status", "opened_on", *extra), F.lit(AS_OF).cast("date"), F.lit(900))


@query(
    "ext01_backlog_ages",
    with_cases(
        f"""SELECT CASE WHEN d <= 5 THEN 1 WHEN d <= 10 THEN 2 WHEN d <= 20 THEN 3 WHEN d <= 30 THEN 4 ELSE 5 END AS ordinal,
          CASE WHEN d <= 5 THEN '0-5 days' WHEN d <= 10 THEN '6-10 days' WHEN d <= 20 THEN '11-20 days' WHEN d <= 30 THEN '21-30 days' ELSE '>30 days' END AS bucket,
          count(*) AS count, {rnd("count(*) * 100e0 / sum(count(*)) OVER ()", 1)} AS pct FROM (SELECT days_open AS d FROM open) GROUP BY 1, 2""",
        OPEN,
    ),
)
def backlog_ages(spark, sf):
    return backlog.backlog_ages(_open(spark, sf))


@query(
    "ext01_backlog_by_cause",
    with_cases(
        f"""SELECT cause, count(*) AS count, {rnd("avg(days_open)", 1)} AS avg_age_days, count(*) FILTER (WHERE is_overdue) AS overdue_count,
          {rnd("count(*) FILTER (WHERE is_overdue) * 100e0 / count(*)", 1)} AS overdue_pct FROM open WHERE cause IS NOT NULL GROUP BY cause HAVING count(*) >= 5""",
        OPEN,
    ),
)
def backlog_by_cause(spark, sf):
    return backlog.backlog_by(_open(spark, sf, "cause"), "cause")


@query(
    "ext01_backlog_summary",
    with_cases(
        f"""SELECT count(*) AS total_open_cases, {rnd("avg(days_open)", 1)} AS avg_age_days, {rnd("median(days_open)", 1)} AS median_age_days,
          {rnd("quantile_cont(days_open, 0.9)", 1)} AS p90_age_days, {rnd("count(*) FILTER (WHERE NOT is_overdue) * 100e0 / count(*)", 1)} AS sla_compliance_pct,
          count(*) FILTER (WHERE is_overdue) AS overdue_cases FROM open""",
        OPEN,
    ),
)
def backlog_summary(spark, sf):
    return backlog.backlog_summary(_open(spark, sf))


@query(
    "ext02_backlog_velocity",
    with_cases(
        """SELECT opened, closed, opened - closed AS net_change FROM (SELECT
        count(*) FILTER (WHERE opened_on > DATE '1999-06-23' AND opened_on <= DATE '1999-06-30') AS opened,
        count(*) FILTER (WHERE closed_on > DATE '1999-06-23' AND closed_on <= DATE '1999-06-30') AS closed FROM cases)"""
    ),
)
def backlog_velocity(spark, sf):
    return backlog.backlog_velocity(cases(spark, sf, "opened_on", "closed_on"), F.lit("1999-06-30").cast("date"))


@query(
    "ext02_breach_risk",
    with_cases(
        f"""SELECT count(*) AS cases_at_risk, coalesce({rnd("avg(days_to_breach)", 1)}, 0e0) AS avg_days_to_breach FROM open
        WHERE days_to_breach BETWEEN 0 AND 30""",
        OPEN,
    ),
)
def breach_risk(spark, sf):
    return backlog.breach_risk(_open(spark, sf), days=30)


def _metrics(spark, sf):
    """One row per supplier and month: the work of an analyst in a period."""
    return cases(spark, sf, "owner_unit", "opened_on", "case_type", "status", "handling_days").groupBy(
        F.col("owner_unit").alias("analyst_id"), F.trunc("opened_on", "month").alias("period")
    ).agg(
        F.element_at(F.array(F.lit("ANALYST"), F.lit("CONTRACTOR_OPERATOR"), F.lit("INTERN_READONLY")),
                     (F.length(F.first("owner_unit")) % 3 + 1)).alias("role"),
        F.count(F.lit(1)).alias("cases_resolved"),
        F.avg("handling_days").alias("avg_resolution_days"),
        (F.count_if(F.col("handling_days") <= 30) * 100.0 / F.count(F.lit(1))).alias("sla_compliance_pct"),
        F.count_if(F.col("case_type") == "queja").alias("rework_count"),
    )


METRICS = """metrics AS (SELECT owner_unit AS analyst_id, (['ANALYST', 'CONTRACTOR_OPERATOR', 'INTERN_READONLY'])[length(owner_unit) % 3 + 1] AS role,
    count(*) AS cases_resolved, avg(handling_days) AS avg_resolution_days, count(*) FILTER (WHERE handling_days <= 30) * 100e0 / count(*) AS sla_compliance_pct,
    count(*) FILTER (WHERE case_type = 'queja') AS rework_count FROM cases GROUP BY owner_unit, date_trunc('month', opened_on)),
  people AS (SELECT analyst_id, role, CAST(sum(cases_resolved) AS BIGINT) AS total_resolved, avg(cases_resolved) AS avg_throughput, avg(avg_resolution_days) AS avg_resolution,
    avg(sla_compliance_pct) AS sla_compliance, sum(rework_count) * 100e0 / sum(cases_resolved) AS rework_rate FROM metrics GROUP BY 1, 2),
  cuts AS (SELECT quantile_cont(avg_throughput, 0.25) AS q1, quantile_cont(avg_throughput, 0.75) AS q3 FROM people)"""


@query(
    "ext03_productivity",
    with_cases(
        f"""SELECT analyst_id, role, total_resolved, {rnd("avg_throughput", 4)} AS avg_throughput, {rnd("rework_rate", 4)} AS rework_rate,
        CASE WHEN avg_throughput >= q3 THEN 'high_performer' WHEN avg_throughput <= q1 THEN 'needs_support' ELSE 'on_track' END AS tier FROM people, cuts""",
        METRICS,
    ),
)
def productivity(spark, sf):
    people = backlog.productivity(_metrics(spark, sf)).select("analyst_id", "role", "total_resolved", "avg_throughput", "rework_rate", "tier")
    return people.withColumns({c: F.round(F.col(c) * 1e4) / 1e4 for c in ("avg_throughput", "rework_rate")})


@query(
    "ext03_productivity_by_role",
    with_cases(
        f"""SELECT role, count(*) AS headcount, {rnd("avg(avg_throughput)", 2)} AS avg_throughput, {rnd("avg(avg_resolution)", 2)} AS avg_resolution_days,
        {rnd("avg(sla_compliance)", 2)} AS sla_compliance_pct FROM people GROUP BY role HAVING count(*) >= 5""",
        METRICS,
    ),
)
def productivity_by_role(spark, sf):
    return backlog.productivity_by_role(backlog.productivity(_metrics(spark, sf)))


WEEKS = """weeks AS (SELECT CAST(date_trunc('week', opened_on) AS DATE) AS week, count(*) AS n, avg(handling_days) AS mean,
    max(handling_days) - min(handling_days) AS range, var_samp(handling_days) AS variance FROM cases GROUP BY 1 HAVING count(*) > 1),
  p AS (SELECT sum(mean * n) / sum(n) AS centre, avg(range) AS range_centre, sqrt(sum(variance * (n - 1)) / sum(n - 1)) AS sigma, count(*) AS subgroups FROM weeks)"""


def _weeks(spark, sf):
    return control.weekly_subgroups(cases(spark, sf, "opened_on", "handling_days"))


@query(
    "ext04_control_chart",
    with_cases(
        f"""SELECT week, n, {rnd("mean", 4)} AS mean, {rnd("range", 4)} AS range, {rnd("centre", 4)} AS centre, {rnd("centre - 3 * sigma / sqrt(n)", 4)} AS lcl,
        {rnd("centre + 3 * sigma / sqrt(n)", 4)} AS ucl, abs(mean - centre) > 3 * sigma / sqrt(n) AS out_of_control,
        range > 2.114e0 * range_centre AS range_out_of_control FROM weeks, p""",
        WEEKS,
    ),
)
def control_chart(spark, sf):
    return control.control_chart(_weeks(spark, sf))


@query(
    "ext04_capability",
    with_cases(
        f"""SELECT subgroups, {rnd("centre", 4)} AS centre, {rnd("sigma", 4)} AS sigma, {rnd("10e0 / (6 * sigma)", 4)} AS cp,
        {rnd("least(10e0 - centre, centre) / (3 * sigma)", 4)} AS cpk FROM p""",
        WEEKS,
    ),
)
def capability(spark, sf):
    return control.capability(_weeks(spark, sf))


@query(
    "ext05_cusum",
    with_cases(
        f"""SELECT week, {rnd("upper", 4)} AS upper, {rnd("lower", 4)} AS lower, greatest(upper, lower) > 4.77 AS shift_detected FROM (
          SELECT week, su - least(0e0, min(su) OVER w) AS upper, sd - least(0e0, min(sd) OVER w) AS lower FROM (
            SELECT week, sum(z - 0.5) OVER w AS su, sum(-z - 0.5) OVER w AS sd FROM (SELECT week, (mean - centre) / (sigma / sqrt(n)) AS z FROM weeks, p)
            WINDOW w AS (ORDER BY week ROWS UNBOUNDED PRECEDING)) WINDOW w AS (ORDER BY week ROWS UNBOUNDED PRECEDING))""",
        WEEKS,
    ),
)
def cusum(spark, sf):
    return control.cusum(_weeks(spark, sf))


@query(
    "ext06_daily_anomalies",
    with_cases(
        f"""SELECT day, volume, {rnd("trend + season", 4)} AS expected, {rnd("remainder", 4)} AS remainder,
          CASE WHEN remainder > q3 + 1.5 * (q3 - q1) THEN 'positive' ELSE 'negative' END AS direction
        FROM r, (SELECT quantile_cont(remainder, 0.25) AS q1, quantile_cont(remainder, 0.75) AS q3 FROM r)
        WHERE remainder > q3 + 1.5 * (q3 - q1) OR remainder < q1 - 1.5 * (q3 - q1)""",
        """d AS (SELECT opened_on AS day, count(*) AS volume FROM cases WHERE opened_on IS NOT NULL GROUP BY 1)""",
        """t AS (SELECT *, volume - trend AS detrended FROM (SELECT *, avg(volume) OVER (ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY FOLLOWING) AS trend FROM d))""",
        """s AS (SELECT dayofweek(day) AS wd, median(detrended) AS season FROM t GROUP BY 1)""",
        """r AS (SELECT t.*, season, detrended - season AS remainder FROM t JOIN s ON dayofweek(day) = wd)""",
    ),
)
def daily_anomalies(spark, sf):
    return control.daily_anomalies(cases(spark, sf, "opened_on"))


@query(
    "ext07_monthly_demand",
    with_cases(
        f"""SELECT month, total_count, avg_days, top_cause, top_channel FROM
          (SELECT CAST(date_trunc('month', opened_on) AS DATE) AS month, count(*) AS total_count, {rnd("avg(handling_days)", 2)} AS avg_days FROM cases WHERE opened_on IS NOT NULL GROUP BY 1)
          LEFT JOIN (SELECT month, cause AS top_cause FROM (SELECT CAST(date_trunc('month', opened_on) AS DATE) AS month, cause,
            row_number() OVER (PARTITION BY date_trunc('month', opened_on) ORDER BY count(*) DESC, cause) AS place FROM cases WHERE cause IS NOT NULL GROUP BY date_trunc('month', opened_on), cause) WHERE place = 1) USING (month)
          LEFT JOIN (SELECT month, channel AS top_channel FROM (SELECT CAST(date_trunc('month', opened_on) AS DATE) AS month, channel,
            row_number() OVER (PARTITION BY date_trunc('month', opened_on) ORDER BY count(*) DESC, channel) AS place FROM cases WHERE channel IS NOT NULL GROUP BY date_trunc('month', opened_on), channel) WHERE place = 1) USING (month)"""
    ),
)
def monthly_demand(spark, sf):
    return control.monthly_demand(cases(spark, sf, "opened_on", "cause", "channel", "handling_days"))


@query(
    "ext08_escalations",
    with_cases(
        """SELECT case_id, opened_on, hours_overdue, CASE WHEN hours_overdue > 48 THEN 'CRITICAL' WHEN hours_overdue > 0 THEN 'NORMAL' ELSE 'REMINDER' END AS level,
          CASE WHEN hours_overdue > 48 THEN 'VP_APPROVER' WHEN hours_overdue > 0 THEN 'OPERATIONS_LEAD' ELSE 'ANALYST' END AS escalate_to FROM (
          SELECT case_id, opened_on, date_diff('hour', CAST(opened_on + 900 AS TIMESTAMP), TIMESTAMP '1999-06-30 06:00:00') * 1e0 AS hours_overdue FROM cases
          WHERE status <> 'cerrado') WHERE hours_overdue > -24"""
    ),
)
def escalations(spark, sf):
    rows = backlog.escalations(cases(spark, sf, "case_id", "status", "opened_on"), F.lit("1999-06-30 06:00:00"), sla_days=900)
    return rows.drop("status")


_DRIFT = ("cause", "channel", "company", "status", "case_type", "outcome")


def _drift_sql() -> str:
    def shares(name: str, where: str) -> str:
        pairs = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM cases WHERE {c} IS NOT NULL AND {where}" for c in _DRIFT)
        return f"{name} AS (SELECT column_name, value, count(*) / sum(count(*)) OVER (PARTITION BY column_name) AS share FROM ({pairs}) GROUP BY 1, 2)"

    return with_cases(
        f"""SELECT column_name, value, {rnd("coalesce(x.share, 0)", 6)} AS source_share, {rnd("coalesce(y.share, 0)", 6)} AS other_share,
          {rnd("abs(coalesce(y.share, 0) - coalesce(x.share, 0)) / nullif(coalesce(x.share, 0), 0)", 4)} AS relative_difference,
          coalesce(abs(coalesce(y.share, 0) - coalesce(x.share, 0)) / nullif(coalesce(x.share, 0), 0) <= 0.1, false) AS within
        FROM x FULL JOIN y USING (column_name, value)""",
        shares("x", "opened_on < DATE '1998-01-01'"),
        shares("y", "opened_on >= DATE '1998-01-01'"),
    )


@query("ext09_drift_check", _drift_sql())
def drift_check(spark, sf):
    every = cases(spark, sf, "opened_on", *_DRIFT)
    cut = F.lit("1998-01-01").cast("date")
    return control.drift_check(every.where(F.col("opened_on") < cut), every.where(F.col("opened_on") >= cut), _DRIFT)


@query(
    "ext09_numeric_profile",
    with_cases(
        f"SELECT 'handling_days' AS column_name, {rnd('avg(handling_days)', 4)} AS mean, {rnd('stddev_samp(handling_days)', 4)} AS std FROM cases"
    ),
)
def numeric_profile(spark, sf):
    rows = control.numeric_profile(cases(spark, sf, "handling_days"))
    return rows.withColumns({c: F.round(F.col(c) * 1e4) / 1e4 for c in ("mean", "std")})
