"""Small inputs with known results."""

import math
from datetime import date
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from casemill.functions import special
from casemill.functions.numbers import coerce_number, to_double
from casemill.functions.severity import alert_level, null_severity, violation_severity
from casemill.functions.text import normalize_status, similarity_ratio, spreadsheet_date
from casemill.operators import (
    access,
    approvals,
    capacity,
    charts,
    contract,
    expectations,
    kpis,
    pareto,
    privacy,
    profiling,
    quality,
    rca,
    requests,
    risk,
    statistics,
)
from casemill.operators.filters import CaseFilter, apply_filters

CASE = "case_id long, opened_on date, closed_on date, status string, cause string, channel string, company string, outcome string, handling_days double, case_type string"


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def clean_cases(spark, n=10):
    day, end = date(2023, 1, 1), date(2023, 2, 1)
    rows = [(i, day, end, "cerrado", "c", "web", "co", "no_accede", 2.0, "queja") for i in range(n)]
    return spark.createDataFrame(rows, CASE)


def test_outliers(spark):
    row = one(statistics.iqr_outliers(numbers(spark, [*range(1, 11), 100]), "v"))
    assert (row.q1, row.q3, row.outlier_count, row.total_count) == (3.5, 8.5, 1, 11)
    for same in ([5] * 10, [42.0] * 100):
        assert one(statistics.iqr_outliers(numbers(spark, same), "v")).outlier_count == 0
    assert one(statistics.iqr_outliers(numbers(spark, [1, 1, 1, 1, 1, 50]), "v")).outlier_count == 0


def test_describe(spark):
    row = one(statistics.describe_numeric(numbers(spark, [1, 2, 3, 4, 5, 5]), "v"))
    assert (row["mean"], row["median"], row["mode"], row["max"]) == (3.33, 3.5, 5.0, 5.0)
    row = one(statistics.describe_numeric(numbers(spark, range(1, 101)), "v"))
    assert (row.q1, row.q2, row.q3, row.p90, row.p95) == (25.75, 50.5, 75.25, 90.1, 95.05)
    row = one(statistics.describe_numeric(numbers(spark, [None, None]), "v"))
    assert (row["count"], row["mean"], row["mode"], row["variance"]) == (0, 0.0, None, 0.0)
    row = one(statistics.describe_numeric(numbers(spark, [7]), "v"))
    assert (row["mean"], row["variance"], row["std"]) == (7.0, 0.0, 0.0)


def test_describe_by_counts_nulls_in_group_size(spark):
    rows = [("a", None)] * 4 + [("a", 1.0)] + [("b", 1.0)] * 4
    found = statistics.describe_by(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()
    assert [(r.g, r["count"]) for r in found] == [("a", 1)]


def categories(spark, counts):
    rows = [(name,) for name, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "cause string")


def test_pareto_core(spark):
    core = pareto.pareto_core(categories(spark, {"A": 50, "B": 25, "C": 15, "D": 7, "E": 3}), "cause").collect()
    assert [r.category for r in core] == ["A", "B", "C"]
    core = pareto.pareto_core(categories(spark, {"X": 85, "Y": 10, "Z": 5}), "cause").collect()
    assert [(r.category, r.proportion) for r in core] == [("X", 0.85)]


def test_pareto_ties_and_flag(spark):
    rows = pareto.pareto(categories(spark, {"A": 10, "B": 5, "C": 5, "D": 4})).collect()
    assert [(r.cause, r.cumulative_pct) for r in rows] == [("A", 50.0), ("B", 100.0), ("C", 100.0)]
    assert [r.high_concentration for r in rows] == [True, False, False]
    strict = pareto.pareto_table(categories(spark, {"A": 10, "B": 5, "C": 5})).collect()
    assert [r.cumulative_proportion for r in strict] == [0.5, 0.75, 1.0]


def test_executive_pareto_of_73_causes(spark):
    counts = [(f"cause_{i:02d}", round(25000 * 0.85**i)) for i in range(73)]
    df = spark.createDataFrame([c for c in counts if c[1] > 0], "cause string, n int").select(
        "cause", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")
    )
    rows = pareto.executive_pareto(df, min_group=1).collect()
    assert len(rows) <= 11
    assert sum(r["count"] for r in rows) == sum(n for _, n in counts)
    assert rows[-1].category == "Otras causas" and rows[-1].cumulative_pct == 100.0
    assert sum(r.grouped for r in rows) == len([c for c in counts if c[1] > 0])


def test_donut_and_empty(spark):
    df = categories(spark, {"A": 60, "B": 40, "C": 2})
    assert [(r.category, r["count"], r.percentage) for r in charts.top_vs_rest(df).collect()] == [
        ("A", 60, 60.0),
        ("Otras causas", 40, 40.0),
    ]
    empty = df.limit(0)
    assert charts.top_vs_rest(empty).count() == 0
    assert one(kpis.main_cause_share(empty)).main_cause_share_pct == 0.0


def test_kpis_of_empty_table(spark):
    row = one(kpis.kpis(clean_cases(spark).limit(0)))
    assert row.total == 0 and row.percentage_closed == 0.0 and row.p95_handling == 0.0


def test_chi_square(spark):
    def table(cells):
        return spark.createDataFrame(
            [(a, b) for (a, b), n in cells.items() for _ in range(n)], "a string, b string"
        )

    uneven = {(r, c): 100 if r == c else (10 if c > r else 5) for r in "xyz" for c in "xyz"}
    assert one(statistics.chi_square(table(uneven), "a", "b")).is_significant
    even = {(r, c): 50 for r in "xyz" for c in "xyz"}
    row = one(statistics.chi_square(table(even), "a", "b"))
    assert (row.statistic, row.p_value, row.degrees_of_freedom, row.is_significant) == (0.0, 1.0, 4, False)
    # Published 2 x 2 example with continuity correction: 10 20 / 30 40.
    row = one(statistics.chi_square(table({("r", "x"): 10, ("r", "y"): 20, ("s", "x"): 30, ("s", "y"): 40}), "a", "b"))
    assert row.degrees_of_freedom == 1 and row.statistic == pytest.approx(0.4464, abs=1e-4)
    assert row.p_value == pytest.approx(0.5040, abs=1e-4)


def test_two_proportions(spark):
    rows = [("a", i < 40) for i in range(100)] + [("b", i < 60) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, c boolean")
    row = one(statistics.two_proportion_z(df, "g", "a", "b", F.col("c")))
    assert row.statistic == pytest.approx(-2.8284, abs=1e-4) and row.p_value == pytest.approx(0.0047, abs=1e-4)
    same = spark.createDataFrame([("a", True), ("b", True)], "g string, c boolean")
    row = one(statistics.two_proportion_z(same, "g", "a", "b", F.col("c")))
    assert (row.statistic, row.p_value) == (0.0, 1.0)


def test_shapiro_published_example(spark):
    row = one(statistics.shapiro_wilk(numbers(spark, [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]), "v"))
    assert (row.statistic, row.p_value, row.is_normal) == (0.7888, 0.0067, False)
    assert statistics.shapiro_wilk(numbers(spark, [1, 2, 3, 4]), "v").count() == 0
    row = one(statistics.shapiro_wilk(numbers(spark, [5.0] * 20), "v"))
    assert (row.statistic, row.p_value) == (1.0, 1.0)


def test_mean_interval(spark):
    row = one(statistics.mean_ci(numbers(spark, range(1, 11)), "v"))
    assert (row["mean"], row.lower, row.upper) == (5.5, 3.33, 7.67)
    assert statistics.mean_ci(numbers(spark, [1, 2, 3, 4]), "v").count() == 0


def test_tails():
    assert special.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-6)
    assert special.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_upper(124.342, 100) == pytest.approx(0.05, abs=1e-5)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert special.normal_quantiles([0.975])[0] == pytest.approx(1.959963984540054, abs=1e-8)


@pytest.mark.parametrize("dof, expected", [(2, 4.302652729911275), (3, 3.182446305284263), (4, 2.776445105197793),
                                           (9, 2.2621571627409915), (30, 2.0422724563012373), (100, 1.9839715184496334)])
def test_t_quantiles_of_few_degrees(dof, expected):
    assert special.t_quantile(0.975, dof) == pytest.approx(expected, abs=1e-8)
    assert special.t_quantile(0.025, dof) == pytest.approx(-expected, abs=1e-8)
    assert special.t_cdf(0.0, dof) == 0.5


@pytest.mark.parametrize("power", range(3, 16))
@pytest.mark.parametrize("p", [0.6, 0.9, 0.975, 0.995, 0.9999])
def test_t_quantiles_of_many_degrees(power, p):
    z, v = NormalDist().inv_cdf(p), 10.0**power
    expansion = (
        z
        + (z**3 + z) / (4 * v)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    )
    assert special.t_quantile(p, v) == pytest.approx(expansion, abs=1e-8)


def test_score_sums_match_direct_sum():
    n = 5000
    whole = special.normal_score(range(1, n + 1), n)
    linear, squares = special.score_sums(1, n, n)
    assert linear == pytest.approx(0.0, abs=1e-4)
    assert squares == pytest.approx(float((whole * whole).sum()), rel=1e-6)
    linear, _ = special.score_sums(301, 2900, n)
    assert linear == pytest.approx(float(whole[300:2900].sum()), rel=1e-6)


def test_conditional_probability(spark):
    rows = [("a", True)] * 3 + [("a", False)] + [("a", None)] + [(None, True)] * 2
    row = one(statistics.conditional_probability(spark.createDataFrame(rows, "g string, c boolean"), F.col("c"), "g"))
    assert (row.probability, row.sample_size, row.is_low_confidence, row.excluded_null_count) == (0.75, 4, True, 2)


def test_wilson_rejects_bad_counts(spark):
    with pytest.raises(Exception, match="wilson_interval"):
        statistics.wilson_interval(spark.createDataFrame([(1, 0)], "k int, n int"), "k", "n").collect()


@pytest.mark.parametrize(
    ("a", "b", "ratio"), [("hello", "hello", 1.0), ("abc", "xyz", 0.0), ("", "", 1.0), ("abc", "", 0.0)]
)
def test_similarity(spark, a, b, ratio):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert one(df.select(similarity_ratio(F.col("a"), F.col("b")).alias("r"))).r == ratio


def test_similar_groups(spark):
    names = ["Cancelacion", "cancelación ", "CANCELACION", "Otra cosa", "Facturacion", "Facturaciones", "zzz"]
    rows = profiling.similar_values(spark.createDataFrame([(n,) for n in names], "c string"), "c").collect()
    groups: dict[str, set] = {}
    for r in rows:
        groups.setdefault(r.component, set()).add(r.value)
    # "facturacion" and "facturaciones" differ in 2 of 13 characters, just below the ratio.
    assert list(map(sorted, groups.values())) == [sorted(["Cancelacion", "cancelación ", "CANCELACION"])]


def test_masking(spark):
    cases = [None, "", "Ana", "Carlos", "A", "AB", "a@b", "María"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(privacy.mask(F.col("t")).alias("m")).collect()
    masked = [r.m for r in rows]
    assert masked[:4] == [None, "", "A*a", "C****s"]
    assert all(len(m) == 8 for m in masked[4:6]) and masked[6:] == ["a*b", "M***a"]
    df = spark.createDataFrame([("x",)], "Correo_Cliente string")
    assert privacy.pii_columns(df) == ["Correo_Cliente"]


def test_quality_of_clean_table(spark):
    row = one(quality.quality_score(clean_cases(spark), date(2024, 1, 1)))
    assert all(v == 100.0 for v in row)
    assert quality.violations(clean_cases(spark), date(2024, 1, 1)).count() == 0


def test_quality_rules_add_up(spark):
    rows = [
        (1, date(2023, 1, 10), date(2023, 1, 1), "cerrado", "c", "w", "co", "accede", 0.0, "queja"),
        (1, None, None, "cerrado", None, "w", "co", None, -1.0, "otro"),
        (2, date(2019, 1, 1), None, "raro", "c", "w", "co", None, 1.0, "queja"),
        (3, date(2030, 1, 1), None, "abierto", "c", "w", "co", None, None, "queja"),
    ]
    df = spark.createDataFrame(rows, CASE)
    row = one(quality.quality_score(df, date(2024, 1, 1)))
    assert row.consistency == 25.0
    assert row.uniqueness == 75.0
    assert row.timeliness == 50.0
    assert row.validity == round((3 + 3 + 2 + 3) * 100 / 15, 2)
    catalogs = spark.createDataFrame([("channel", "x")], "field string, value string")
    assert one(quality.referential_integrity(df, date(2024, 1, 1), catalogs)).referential_integrity == 0.0


def test_severities(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 5.0, 5.1, 10.1, 20.0, 20.1)], "p double")
    rows = df.select(violation_severity(F.col("p")).alias("v"), null_severity(F.col("p")).alias("n")).collect()
    assert [r.v for r in rows] == ["low", "low", "medium", "high", "high", "critical"]
    assert [r.n for r in rows] == ["low", "medium", "medium", "medium", "medium", "high"]


def test_types(spark):
    rows = [(str(i), "si" if i % 2 else "no", f"2024-01-{i + 1:02d}", f"text {i % 3}", "1" if i < 5 else "x", None) for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    kinds = {r.column_name: r.inferred_type for r in profiling.infer_types(df).collect()}
    assert kinds == {"a": "numeric", "b": "boolean", "c": "datetime", "d": "categorical", "e": "mixed", "f": "unknown"}


def test_number_and_date_parsing(spark):
    rows = [("0001", "43831", "En  Proceso"), ("1d", "0", "CERRADO"), ("NaN", "-3", "x y z"), (" 2.5 ", "abc", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    found = df.select(
        to_double(F.col("a")).alias("a"), spreadsheet_date(F.col("b")).alias("b"), normalize_status(F.col("c")).alias("c"),
        coerce_number(F.col("a")).alias("d"),
    ).collect()
    assert [r.a for r in found] == [1.0, None, None, 2.5]
    assert [r.b for r in found] == [date(2020, 1, 1), None, None, None]
    assert [r.c for r in found] == ["en_proceso", "cerrado", "x_y_z", None]
    assert found[2].d == 0.0


def test_filters(spark):
    df = clean_cases(spark)
    assert apply_filters(df, CaseFilter()).count() == 10
    assert apply_filters(df, CaseFilter(statuses=("abierto",))).count() == 0
    assert apply_filters(df, CaseFilter(outcomes=("no_accede",), time_min=2, time_max=2)).count() == 10
    bad = CaseFilter(date_start="2024-02-30", date_end="2024-01-01", time_min=-1, time_max=0, causes=tuple("x" * 101))
    assert len(bad.validate()) == 3
    assert CaseFilter(date_start="2024-02-01", date_end="2024-01-01", time_min=3, time_max=2).validate() == [
        "date_start is after date_end",
        "time_min is greater than time_max",
    ]
    with pytest.raises(ValueError):
        apply_filters(df, bad)


def test_contract(spark):
    good = clean_cases(spark, 3)
    valid, bad = contract.validate_contract(good)
    assert (valid.count(), bad.count()) == (3, 0)
    twice = good.unionByName(good.where("case_id = 1"))
    valid, bad = contract.validate_contract(twice)
    assert (valid.count(), bad.count()) == (2, 2)
    assert contract.validate_contract(twice, enforce_unique=False)[0].count() == 4
    wrong = good.withColumn("status", F.lit("bad")).withColumn("case_type", F.lit("worse"))
    assert one(contract.validate_contract(wrong.limit(1))[1]).reason == "status: not in domain; case_type: not in domain"


def test_capacity(spark):
    df = spark.createDataFrame([(0.0, 0.85, 0.0), (100.0, 0.5, 50.0), (32.0, 0.85, 40.0)], "hours double, productivity_factor double, assigned_work double")
    rows = capacity.capacity_by_user(df).collect()
    assert [(r.net_capacity, r.utilization, r.alert_level) for r in rows[:2]] == [(0.0, 0.0, "green"), (50.0, 100.0, "yellow")]
    assert rows[2].alert_level == "red"
    with pytest.raises(Exception, match="hours"):
        capacity.capacity_by_user(df.withColumn("hours", F.lit(-1.0))).collect()
    levels = spark.createDataFrame([(85.0,), (85.1,), (100.0,), (120.0,), (120.1,)], "u double")
    assert [r[0] for r in levels.select(alert_level(F.col("u"))).collect()] == ["green", "yellow", "yellow", "orange", "red"]


def test_main_cause(spark):
    row = one(rca.identify_main_cause(categories(spark, {"A": 40, "B": 35, "C": 25})))
    assert (row.cause_name, row.percentage_share, row.is_confirmed) == ("A", 0.4, False)
    assert one(rca.identify_main_cause(categories(spark, {"A": 45, "B": 55}))).is_confirmed
    assert one(rca.identify_main_cause(categories(spark, {"A": 1}).limit(0))).record_count == 0


def test_fmea(spark):
    df = spark.createDataFrame([("a", 1, 2, 3), ("b", 5, 5, 5), ("c", 5, 5, 5)], "mode string, severity int, occurrence int, detection int")
    row = one(rca.fmea(df))
    assert (row.total_rpn, row.average_rpn, row.highest_mode, row.highest_rpn) == (256, 85.33, "b", 125)
    with pytest.raises(Exception, match="ratings"):
        rca.fmea(df.withColumn("severity", F.lit(6))).collect()


def test_expectations(spark):
    for n, within in ((51_008, True), (50_497, True), (51_518, True), (40_000, False), (60_000, False)):
        df = spark.range(n).select(
            F.col("id").alias("case_id"), F.lit("c").alias("cause"), F.lit(7.0).alias("handling_days"), F.lit("Telefonico").alias("channel"),
            F.lit("x").alias("close_reason"), F.lit("m").alias("marking"), F.lit(" co").alias("company"),
        )
        rows = {r.name: r for r in expectations.reference_checks(df).collect()}
        assert rows["record_count"].within is within
        assert rows["phone_verbal_share"].within and rows["company_inconsistent"].actual == 100.0
        assert not rows["main_cause_share"].within


def test_transitions(spark):
    rows = [
        ("Solicitada", "En_Revision", "OPERATIONS_LEAD", "long enough reason", 200),
        ("Solicitada", "En_Revision", "OPERATIONS_LEAD", "short", 400),
        (None, "En_Revision", "OPERATIONS_LEAD", "short", 422),
        ("Cerrada", "En_Revision", "SYSTEM_ADMIN", "long enough reason", 422),
        ("En_Revision", "Aprobada", "ANALYST", "long enough reason", 403),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "current_state string, target_state string, role string, justification string")
    found = {(r.current_state, r.target_state, r.role, r.justification): r.code for r in requests.check_transitions(df, requests.transition_rules(spark)).collect()}
    assert [found[r[:4]] for r in rows] == [r[4] for r in rows]


def test_roles_and_approvals(spark):
    matrix = access.permission_matrix(spark)
    assert matrix.count() == sum(len(p) for p in access.ROLE_PERMISSIONS.values())
    rules = approvals.approval_rules(spark)
    steps = approvals.expand_steps(spark.createDataFrame([(1, "RBAC_CHANGE"), (2, "DATA_DELETION")], "request_id int, operation string"), rules)
    assert sorted((r.request_id, r.step_order, r.approver_role) for r in steps.collect()) == [
        (1, 1, "LEGAL_APPROVER"),
        (1, 2, "VP_APPROVER"),
        (2, 1, "LEGAL_APPROVER"),
    ]


def test_risk_metrics(spark):
    rows = [(1, 1, 0.9, 2.0), (0, 1, 0.8, 1.0), (1, 0, 0.4, 1.0), (0, 0, 0.4, 3.0), (0, 0, 0.1, 2.0)]
    row = one(risk.evaluate(spark.createDataFrame(rows, "label int, prediction int, score double, n double")))
    assert (row.precision, row.recall, row.f1_score) == (0.6667, 0.6667, 0.6667)
    assert row.roc_auc == pytest.approx((2 * 6 + 1 * (2 + 1.5)) / 18, abs=1e-4)


def test_risk_placeholder(spark):
    df = clean_cases(spark).withColumns({"owner_unit": F.lit("u"), "marking": F.lit("m")})
    row = one(risk.risk_report(df))
    assert row.roc_auc == 0.0 and "both classes" in row.limitations
    assert risk.report_problems(risk.risk_report(df)).count() == 0


def test_split_is_exact_and_repeatable(spark):
    rows = [(f"f{i % 7}", int(i % 10 == 0), float(i % 5 + 1)) for i in range(200)] + [("hot", 0, 4000.0)]
    df = spark.createDataFrame(rows, "cause string, label int, n double").groupBy("cause", "label").agg(F.sum("n").alias("n"))
    first, second = (
        {(r.cause, r.label, r.is_test): r.n for r in risk.stratified_split(df).collect()} for _ in range(2)
    )
    assert first == second
    totals = {r.label: r.n for r in df.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    for label, n in totals.items():
        assert sum(v for (c, l, t), v in first.items() if l == label and t) == math.floor(n * 0.25 + 0.5)
        assert sum(v for (c, l, t), v in first.items() if l == label) == n
    assert abs(first[("hot", 0, True)] - 1000) <= 1




def test_limits_of_the_profile_are_parameters(spark):
    from casemill.operators import profiling

    names = spark.createDataFrame([(f"company number {chr(97 + i % 26)}{i}",) for i in range(60)], "company string")
    kind = lambda **k: profiling.infer_types(names, **k).first()["inferred_type"]
    assert (kind(), kind(categorical_limit=61), kind(categorical_limit=60)) == ("text", "categorical", "text")
    assert profiling.profile_columns(names).first()["similar_groups"] == "[]"
    assert "company number" in profiling.profile_columns(names, categorical_limit=61).first()["similar_groups"]
    assert len(profiling.validate_dates(names, "company", samples=12).first()["sample_invalid_values"]) == 12
