"""Shape of physical plans: what reaches the scan, what is never shuffled or collected."""

import re

from pyspark.sql import functions as F

from casemill.operators import charts, filters, kpis, pareto, quality
from casemill.operators.filters import CaseFilter
from casemill.sources.readers import read_cases
from casemill.workload.tables import cases


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> list[str]:
    return re.findall(r"FileScan parquet \[([^\]]*)\]", plan(df))


def table(spark, sf, folder):
    path = folder("cases")
    cases(spark, sf).write.parquet(path)
    return read_cases(spark, path)


def columns_of(scan: str) -> set[str]:
    return {c.split("#")[0] for c in scan.split(",") if c}


def test_filters_reach_the_scan(spark, sf, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = table(spark, sf, folder)
    chosen = CaseFilter(date_start="1996-01-01", companies=("NATION_1",), time_min=3)
    text = plan(filters.apply_filters(df, chosen).groupBy("cause").count())
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    for part in ("GreaterThanOrEqual(opened_on", "company", "GreaterThanOrEqual(handling_days,3.0)"):
        assert part in pushed


def test_only_needed_columns_are_read_once(spark, sf, folder):
    df = table(spark, sf, folder)
    for result, needed in (
        (kpis.kpis(df), {"status", "cause", "handling_days"}),
        (charts.handling_box(df), {"cause", "handling_days"}),
        (charts.completeness_by_field(df), set(charts.COMPLETENESS_FIELDS)),
        (filters.filter_options(df), set(filters.LIST_FIELDS.values())),
    ):
        found = scans(result)
        assert len(found) == 1 and columns_of(found[0]) == needed


def test_one_pass_dimensions_do_not_count_ids(spark, sf, folder):
    from datetime import date

    df = table(spark, sf, folder)
    assert len(scans(quality.validity(df, date(2001, 1, 1)))) == 1
    assert "case_id" not in columns_of(scans(quality.consistency(df, date(2001, 1, 1)))[0])


def test_pareto_orders_sizes_not_groups(spark, sf, folder):
    df = table(spark, sf, folder)
    text = plan(pareto.pareto(df, "owner_unit"))
    unpartitioned = [w for w in re.findall(r"Window \[(.*)\]", text) if "windowspecdefinition(count" in w and "row_number" not in w]
    assert unpartitioned and all("owner_unit" not in w for w in unpartitioned)


def test_case_view_joins_only_what_is_wanted(spark, sf):
    assert plan(cases(spark, sf, "handling_days", "outcome")).count("FileScan") == 1
    assert plan(cases(spark, sf, "cause").groupBy("cause").agg(F.count("*"))).count("FileScan") == 2


def test_rule_tables_do_not_shuffle_the_facts(spark, sf):
    from casemill.operators import requests
    from casemill.workload.operations import _attempts

    text = plan(requests.check_transitions(_attempts(spark, sf), requests.transition_rules(spark)))
    assert text.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in text


def test_large_rule_tables_are_not_broadcast(spark):
    from casemill.functions.joins import small

    assert "broadcast" in small(spark.range(5), rows=5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(spark.range(6), rows=5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(spark.range(5), size=20)._jdf.queryExecution().logical().toString().lower()


def test_curated_months_are_balanced_by_their_bytes(spark, folder):
    from casemill.sources.sinks import write_curated

    rows = spark.range(0, 5_000, 1, 8).select("id", F.expr("date_add(date'2024-01-01', if(id % 10 < 9, 0, cast(id % 300 as int)))").alias("opened_on"))
    write_curated(rows, folder("curated"))
    back = spark.read.parquet(folder("curated"))
    assert back.select("id", "opened_on").exceptAll(rows).isEmpty() and back.count() == 5_000
    assert back.where("opened_month <> date_format(opened_on, 'yyyy-MM')").isEmpty()
    # One task a month here, where months are small: no file for each of many salts.
    assert len(back.inputFiles()) == back.select("opened_month").distinct().count()
