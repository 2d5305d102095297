"""Membership filters: files are left out by plan, false positives cost no row, files without a filter are read."""

import pytest

from casemill.sources import membership, sinks

SCHEMA = "k long, v string"


def table_of(spark, path, parts, bits=membership.BITS_PER_KEY):
    for n, keys in enumerate(parts):
        sinks.insert_missing(spark, path, spark.createDataFrame([(k, f"{n}") for k in keys], SCHEMA).coalesce(1), ["k"], bits)
    return spark.createDataFrame([], SCHEMA).schema


def test_only_files_that_may_hold_a_key_are_read(spark, folder):
    parts = [range(i * 1000, i * 1000 + 500) for i in range(6)]
    schema = table_of(spark, folder("t"), parts)
    assert len(membership.stored_files(spark, folder("t"))) == 6
    wanted = spark.createDataFrame([(2003, "x"), (4499, "x"), (777, "new")], SCHEMA)
    held = membership.holding(wanted, folder("t"), schema, ["k"])
    read = held.inputFiles()
    assert 2 <= len(read) <= 3
    plan = held._jdf.queryExecution().toString()
    left_out = [f for f in membership.stored_files(spark, folder("t")) if f not in read]
    assert len(left_out) >= 3 and "ReadSchema: struct<k:bigint>" in plan
    assert {2003, 4499} <= {r.k for r in held.collect()}
    assert membership.holding(spark.createDataFrame([(-5, "x")], SCHEMA), folder("t"), schema, ["k"]) is None


def test_false_positives_cost_no_row(spark, folder):
    # Less than a bit per key: nearly every probe of such a filter hits.
    schema = table_of(spark, folder("t"), [range(0, 3000), range(5000, 8000)], bits=0)
    wanted = spark.createDataFrame([(k, "x") for k in range(3000, 3200)], SCHEMA)
    assert len(membership.candidate_files(wanted, folder("t"), schema, ["k"])) == 2
    sinks.insert_missing(spark, folder("t"), wanted.union(spark.createDataFrame([(1, "again")], SCHEMA)), ["k"])
    rows = spark.read.parquet(folder("t")).collect()
    assert len(rows) == len({r.k for r in rows}) == 6200 and not [r for r in rows if r.v == "again"]


def test_files_without_a_filter_and_filters_without_a_file(spark, folder):
    schema = table_of(spark, folder("t"), [range(0, 100)])
    # Written past the index, as after a failure before its filter.
    spark.createDataFrame([(500, "other")], SCHEMA).write.mode("append").parquet(folder("t"))
    sinks.insert_missing(spark, folder("t"), spark.createDataFrame([(500, "again"), (501, "new")], SCHEMA), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(folder("t")).where("k >= 500").collect()) == [(500, "other"), (501, "new")]
    spark.createDataFrame([(7, "fresh")], SCHEMA).write.mode("overwrite").parquet(folder("t"))
    assert [r.k for r in membership.holding(spark.createDataFrame([(7, "x")], SCHEMA), folder("t"), schema, ["k"]).collect()] == [7]


@pytest.mark.parametrize("kind, keys", [("double", [0.0, -0.0, 1.5]), ("string", ["", "é", "a"]), ("decimal(10,2)", [1, 2, 3])])
def test_equal_keys_are_found_in_every_type(spark, folder, kind, keys):
    df = spark.createDataFrame([(k, 1) for k in map(str, keys)], "k string, v int").selectExpr(f"cast(k as {kind}) k", "v")
    sinks.insert_missing(spark, folder("t"), df, ["k"])
    before = spark.read.parquet(folder("t")).count()
    sinks.insert_missing(spark, folder("t"), df, ["k"])
    assert spark.read.parquet(folder("t")).count() == before


def test_null_keys_and_several_columns(spark, folder):
    df = spark.createDataFrame([(1, "a", 0), (None, "a", 1), (1, None, 2), (2, "a", 3)], "k long, s string, v int")
    sinks.insert_missing(spark, folder("t"), df.limit(1), ["k", "s"])
    sinks.insert_missing(spark, folder("t"), df, ["k", "s"])
    assert sorted(r.v for r in spark.read.parquet(folder("t")).collect()) == [0, 1, 2, 3]


def test_files_whose_bounds_lie_elsewhere_are_left_out(spark, folder):
    schema = table_of(spark, folder("t"), [range(0, 100), range(100, 200), range(200, 300)])
    # Written past the index: it has no bounds and stays.
    spark.createDataFrame([(5, "other")], SCHEMA).coalesce(1).write.mode("append").parquet(folder("t"))
    files = membership.stored_files(spark, folder("t"))

    def near(*wanted):
        keys = spark.createDataFrame([(k, "x") for k in wanted], SCHEMA)
        return len(membership.overlapping_files(keys, folder("t"), schema, ["k"], files))

    assert [near(1000, 2000), near(99), near(99, 160), near(170), near(None)] == [1, 2, 3, 2, 4]
    double = spark.createDataFrame([(1.0,)], "k double")
    assert len(membership.overlapping_files(double, folder("t"), double.schema, ["k"], files)) == 4


def test_growing_ids_are_not_searched_in_the_files_of_earlier_batches(spark, folder, monkeypatch):
    from casemill.streaming import files

    searched, search = [], membership.candidate_files
    monkeypatch.setattr(membership, "candidate_files", lambda w, p, s, k, f=None: searched.append(len(f)) or search(w, p, s, k, f))

    def load(ids):
        rows = spark.createDataFrame([(i,) for i in ids], "case_id long").selectExpr(
            "case_id", "date'2000-01-01' opened_on", "'abierto' status", "'a' cause", "'b' channel", "'c' company", "'queja' case_type",
            "1d handling_days",
        )
        rows.coalesce(1).write.mode("append").json(folder("in"))
        files.ingest_files(
            spark, folder("in"), rows.schema, folder("curated"), folder("bad"), folder("check"), min_date="1900-01-01"
        ).awaitTermination()
        return spark.read.parquet(folder("curated")).count(), spark.read.parquet(folder("bad")).count()

    for n in range(3):
        held = load(range(n * 50, n * 50 + 50))
    assert held == (150, 0) and not searched
    assert load([149, 500]) == (151, 1) and searched == [1]
