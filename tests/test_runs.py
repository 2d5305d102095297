"""Sources, sinks and multi-stage runs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from casemill.functions import numbers, quantiles
from casemill.operators import profiling, quality
from casemill.plans import ingest, migrate as migration, report
from casemill.schema import CASE_SCHEMA
from casemill.session import durable
from casemill.sources import readers, sinks
from casemill.workload import sources
from casemill.workload.tables import cases


def test_detect_format():
    assert readers.detect_format("/a/b.CSV") == "csv" and readers.detect_format("x.jsonl") == "json"
    with pytest.raises(ValueError):
        readers.detect_format("/a/book.xlsx")


def test_standard_names():
    assert readers.standard_names([" Fecha Creación ", "a--b", "A B", "???", ""]) == [
        "fecha_creaci_n", "a_b", "a_b_2", "column_3", "column_4",
    ]


def test_validate_source(spark, folder):
    spark.range(3).write.parquet(folder("ok.parquet"))
    assert readers.validate_source(spark, folder("ok.parquet")).count() == 0
    spark.range(0).write.parquet(folder("empty.parquet"))
    assert [r.level for r in readers.validate_source(spark, folder("empty.parquet")).collect()] == ["error"]
    assert [r.level for r in readers.validate_source(spark, folder("missing.csv")).collect()] == ["error"]


def test_insert_missing_twice_adds_nothing(spark, folder):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "z")], "k int, v string")
    second = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for batch in (first, second, second):
        sinks.insert_missing(spark, folder("t"), batch, ["k"])
    assert sorted(map(tuple, spark.read.parquet(folder("t")).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_quarantine_widens(spark, folder):
    rows = spark.createDataFrame([(1, "x" * 600)], "a int, reason string")
    at = F.current_timestamp()
    sinks.write_quarantine(sinks.quarantine_rows(rows, at, "R1", F.col("reason")), folder("q"))
    sinks.write_quarantine(sinks.quarantine_rows(rows, at, "R2", "short").withColumn("extra", F.lit(1)), folder("q"))
    found = sinks.read_quarantine(spark, folder("q")).orderBy("rule_id").collect()
    assert [len(r.reason) for r in found] == [600, 5] and found[0].extra is None and found[0].record_data == '{"a":1}'


def test_audit_lines_skip_malformed(spark, folder):
    rows = spark.createDataFrame([(1, "u", "a", "r", "success"), (2, "", "a", "r", "success"), (3, "u", "a", "r", "maybe")],
                                 "event_id long, user_id string, action string, resource string, result string")
    sinks.append_audit(rows, folder("log"))
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(folder("log"))
    assert [r.event_id for r in readers.read_audit(spark, folder("log")).collect()] == [1]


def test_curated_table_prunes_months(spark, sf, folder):
    sinks.write_curated(cases(spark, sf), folder("c"))
    back = spark.read.parquet(folder("c"))
    assert back.count() == cases(spark, sf).count()
    assert back.where("opened_month = '1996-05'").count() == cases(spark, sf).where("opened_on between '1996-05-01' and '1996-05-31'").count()


def test_ingest_run_is_idempotent(spark, sf, folder):
    cases(spark, sf).write.parquet(folder("in.parquet"))
    config = ingest.IngestConfig(folder("in.parquet"), folder("out"), date(2001, 12, 31), min_date="1995-01-01", enforce_unique=False)
    assert ingest.run_pipeline(spark, config) == "completed"
    assert ingest.run_pipeline(spark, config) == "skipped"
    row = ingest.read_control(spark, folder("out")).first()
    assert row.status == "completed" and row.stages_completed == ",".join(ingest.STAGES)
    assert row.records_read == row.records_valid + row.records_quarantined == cases(spark, sf).count()
    assert ingest.read_curated(spark, folder("out")).count() == row.records_valid
    assert ingest.read_quarantined(spark, folder("out")).count() == row.records_quarantined
    assert ingest.read_report(spark, folder("out")).first().total_record_count == row.records_read


def test_failed_run_is_recorded(spark, folder):
    spark.createDataFrame([("x",)], "nothing string").write.parquet(folder("in.parquet"))
    config = ingest.IngestConfig(folder("in.parquet"), folder("out"), date(2001, 12, 31))
    assert ingest.run_pipeline(spark, config) == "failed"
    row = ingest.read_control(spark, folder("out")).first()
    assert row.status == "failed" and row.stages_completed == "ingest" and row.error


def case_rows(spark, rows):
    """Cases from (id, opening day); all other required columns are filled, the rest is null."""
    df = spark.createDataFrame(rows, "case_id long, opened_on string")
    filled = {"status": "abierto", "cause": "a", "channel": "b", "company": "c", "case_type": "queja", "handling_days": 1.0}
    columns = [F.col(f.name) if f.name in df.columns else F.lit(filled.get(f.name)) for f in CASE_SCHEMA.fields]
    return df.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, CASE_SCHEMA.fields)])


BREAKS = {
    "hash": ("source_files", readers), "control": ("pending_files", sinks), "ingest": ("read_source", readers),
    "profile": ("export_report", sinks), "validate": ("write_quarantine", sinks), "enrich": ("violations", ingest),
    "serve": ("write_curated", sinks), "publish": ("publish", ingest.commits), "after": ("release", ingest),
}


def test_a_run_that_fails_in_any_stage_shows_nothing_and_its_repetition_every_row_once(spark, folder, monkeypatch):
    case_rows(spark, [(i, "2000-01-01" if i % 4 else "1980-01-01") for i in range(40)]).write.parquet(folder("in.parquet"))
    config = ingest.IngestConfig(folder("in.parquet"), folder("out"), date(2001, 12, 31), min_date="1995-01-01")

    def broken(*_, **__):
        raise OSError("lost")

    for stage, (name, module) in BREAKS.items():
        with monkeypatch.context() as patch:
            patch.setattr(module, name, broken)
            assert ingest.run_pipeline(spark, config) == "failed", stage
        visible = ingest.commits.batches(spark, folder("out"))
        # The entry of the manifest is the commit: what fails after it has been published all the same.
        assert len(visible) == (stage == "after"), stage
    assert ingest.run_pipeline(spark, config) == "skipped"
    assert sorted(r.case_id for r in ingest.read_curated(spark, folder("out")).collect()) == [i for i in range(40) if i % 4]
    assert ingest.read_quarantined(spark, folder("out")).count() == 10
    failed = ingest.read_control(spark, folder("out")).where("status = 'failed'")
    assert failed.count() == len(BREAKS) and failed.where("file_hash IS NULL").count() == 2
    # A second entry of the same source, as two runs at once would write, changes nothing.
    ingest.commits.publish(spark, folder("out"), "other", ingest.commits.published(spark, folder("out")).first().source_key)
    assert ingest.read_quarantined(spark, folder("out")).count() == 10


def test_quarantine_of_all_batches_and_curated_rows_of_the_last(spark, folder):
    for n, day in ((1, "2000-01-01"), (2, "2000-01-02")):
        case_rows(spark, [(n, day), (9, None)]).write.parquet(folder(f"in{n}.parquet"))
        config = ingest.IngestConfig(folder(f"in{n}.parquet"), folder("out"), date(2001, 12, 31), min_date="1995-01-01")
        assert ingest.run_pipeline(spark, config) == "completed"
    assert [r.case_id for r in ingest.read_curated(spark, folder("out")).collect()] == [2]
    assert ingest.read_quarantined(spark, folder("out")).count() == 2


def test_migration_loads_once(spark, sf, folder):
    source = sources._dirty(spark, sf)
    first = migration.migrate(spark, source, folder("t"), folder("q"), "m").first()
    loaded = spark.read.parquet(folder("t")).count()
    migration.migrate(spark, source, folder("t"), folder("q"), "m")
    assert spark.read.parquet(folder("t")).count() == loaded
    assert first.status == "failed" and first.source_count == source.count()
    assert first.quarantined_count >= first.failed_records


def test_report_names_unsupported_columns(spark):
    df = spark.createDataFrame([(1, [1]), (2, [2])], "case_id long, tags array<int>")
    found = report.quality_report(df, date(2024, 1, 1))
    assert found.errors == ("tags: type array has no profile",)
    assert found.summary.first().overall_completeness_pct == 100.0
    with pytest.raises(ValueError):
        report.quality_report(df.select("tags"), date(2024, 1, 1))


def test_migration_counts_come_from_the_target(spark, sf, folder):
    source = sources._dirty(spark, sf)
    first = migration.migrate(spark, source, folder("t"), folder("q"), "m").first()
    held, failures = spark.read.parquet(folder("t")).count(), spark.read.parquet(folder("q")).count()
    assert first.loaded_count == held and first.remaining_count == 0 and first.present_count >= held
    again = migration.migrate(spark, source, folder("t"), folder("q"), "m").first()
    assert again.loaded_count == 0 and again.present_count == first.present_count
    assert spark.read.parquet(folder("q")).count() == failures


def test_migrations_keep_each_others_quarantine(spark, sf, folder):
    source = sources._dirty(spark, sf)
    migration.migrate(spark, source, folder("t"), folder("q"), "first")
    failures = spark.read.parquet(folder("q")).count()
    migration.migrate(spark, source, folder("t"), folder("q"), "second")
    held = spark.read.parquet(folder("q")).groupBy("batch_id").count().collect()
    assert failures > 0 and sorted(map(tuple, held)) == [("first", failures), ("second", failures)]


def test_aborted_migration_reports_what_remains(spark, sf, folder, monkeypatch):
    def broken(*_):
        raise OSError("disk full " + "x" * 500)

    monkeypatch.setattr(migration, "insert_missing", broken)
    row = migration.migrate(spark, sources._dirty(spark, sf), folder("t"), folder("q"), "m").first()
    assert row.status == "aborted" and row.loaded_count == 0 and row.present_count == 0 and row.remaining_count > 0
    assert row.error.endswith("x" * 500)


def test_a_stored_table_is_counted_as_any_other(spark, folder):
    rows = [(1, 0.5, "a", "2020-01-01", True), (1, -0.0, None, None, False), (None, 0.0, "", "2020-01-01", None), (2, float("nan"), "a", "1999-12-31", True)]
    df = spark.createDataFrame(rows, "case_id long, x double, t string, d string, b boolean").withColumns({"d": F.col("d").cast("date"), "e f": F.lit(1.5).cast("decimal(5,2)")})
    counted = lambda **k: sorted(map(str, profiling.column_values(df, **k).collect()))
    assert counted(stored=True) == counted()
    summary = lambda **k: report.quality_report(df, date(2024, 1, 1), **k).summary.collect()
    assert summary(stored=True) == summary()


def test_ids_of_a_report_are_counted_from_its_values(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "case_id long")
    values = profiling.column_values(df)
    assert profiling.dataset_metrics(df, values=values).collect() == profiling.dataset_metrics(df).collect()
    assert profiling.dataset_metrics(df, values=values).first().duplication_rate == 60.0


def test_outlier_fences_move_no_distinct_values(spark, monkeypatch):
    """Before, all distinct values of a column met their fences in one task."""
    made, kept = [], profiling.durable
    monkeypatch.setattr(profiling, "durable", lambda df: made.append(kept(df)) or made[-1])
    values = spark.createDataFrame([("x", str(i), 1) for i in range(100)] + [("x", "1000", 2), ("x", "1000,0", 3), ("x", "?", 9), ("y", "1", 4)], "column_name string, value string, n long")
    found = profiling._outliers_of_values(values)
    assert [(r.column_name, r.outlier_count) for r in found.collect()] == [("x", 5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "rightHint=(strategy=broadcast)" in plan


def test_only_ranges_that_hold_a_quantile_are_ordered(spark, monkeypatch):
    seen, placed = [], quantiles._placed
    monkeypatch.setattr(quantiles, "_placed", lambda dealt, places: seen.append((dealt, places)) or placed(dealt, places))
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 9973).cast("double").alias("v"))
    counts = quantiles.value_counts(df, "v", ["g"])
    for few in (False, True):
        found = {r.g: r.q for r in quantiles.quantiles_of_counts(counts, {"q": 0.5}, ["g"], few_groups=few).collect()}
        assert found == {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("q")).collect()}
    dealt, places = seen[0]
    assert places.count() <= 4 < dealt.select("_k", "_range").distinct().count()


def test_a_finite_double_is_what_its_text_gives(spark):
    rows = [(x,) for x in (0.0, -0.0, 1.5, 1e300, 5e-324, -1e-7, float("inf"), float("-inf"), float("nan"), None)]
    df = spark.createDataFrame(rows, "x double").select(numbers.finite(F.col("x")).alias("a"), numbers.to_double(F.col("x")).alias("b"))
    assert df.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def test_score_and_violations_share_one_row_of_counters(spark):
    df = case_rows(spark, [(1, "2020-01-01"), (1, "1980-01-01"), (None, None)])
    catalogs = spark.createDataFrame([("cause", "z")], "field string, value string")
    for listed in (None, catalogs):
        rules = (date(2024, 1, 1), listed, "1995-01-01")
        counters = durable(quality.quality_counters(df, *rules))
        assert quality.quality_score(df, *rules, counters=counters).collect() == quality.quality_score(df, *rules).collect()
        assert quality.violations(df, *rules, counters=counters).collect() == quality.violations(df, *rules).collect()
