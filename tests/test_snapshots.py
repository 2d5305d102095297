"""Snapshots compared from their digest trees: same rows as a full comparison, untouched ranges are not read."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casemill.operators.audit import append_only_violations
from casemill.sources import snapshots


def log(spark, n=2_000):
    return spark.range(0, n, 1, 4).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("u"), F.col("id") % 13)).alias("user_id"),
        F.timestamp_micros(F.col("id") * 1_000_003).alias("timestamp"),
        F.array(F.col("id"), F.lit(None).cast("long")).alias("places"),
        F.lit("ok").alias("result"),
    )


def compared(spark, folder, old, new, most=snapshots.NODES, bits=(6, 6)):
    paths = [folder("old"), folder("new")]
    for df, path, b in zip((old, new), paths, bits):
        snapshots.write_snapshot(df, path, range_bits=b)
    found = snapshots.snapshot_violations(spark, *paths, most)
    key = lambda r: repr(r)
    assert sorted(found.collect(), key=key) == sorted(append_only_violations(old, new).collect(), key=key)
    return found, paths


def edited(old):
    later = F.when(F.col("event_id") == 130, F.timestamp_micros(F.unix_micros("timestamp") + 1)).otherwise(F.col("timestamp"))
    return old.where("event_id <> 1000").withColumn("timestamp", later)


def test_changed_and_lost_rows_are_found_in_their_ranges_alone(spark, folder):
    old = log(spark)
    found, paths = compared(spark, folder, old, edited(old).union(log(spark, 2_100).where("event_id >= 2000")))
    assert {r.event_id for r in found.collect()} == {130, 1000}
    level, nodes = snapshots.differing_nodes(spark, *paths)
    # 2000 to 2047 share a range with appended rows: it differs, but nothing of it is missing.
    assert (level, nodes) == (0, [130 >> 6, 1000 >> 6, 2000 >> 6])
    for path in paths:
        for file in Path(path, "rows").glob("_range=*/*.parquet"):
            if int(file.parent.name.split("=")[1]) not in nodes:
                file.write_bytes(b"unreadable")
    again = snapshots.snapshot_violations(spark, *paths)
    assert {r.event_id for r in again.collect()} == {130, 1000}


def test_an_unchanged_log_reads_no_rows(spark, folder):
    old = log(spark, 300)
    _, paths = compared(spark, folder, old, old)
    assert snapshots.differing_nodes(spark, *paths) == (0, [])
    for path in paths:
        for file in Path(path, "rows").glob("_range=*/*.parquet"):
            file.write_bytes(b"unreadable")
    assert snapshots.snapshot_violations(spark, *paths).count() == 0


def test_many_differences_take_a_higher_level(spark, folder):
    old = log(spark)
    _, paths = compared(spark, folder, old, old.where("event_id % 50 <> 3"), most=3)
    level, nodes = snapshots.differing_nodes(spark, *paths, most=3)
    assert level > 0 and len(nodes) <= 3


def test_more_differences_than_the_top_level_allows_are_compared_whole(spark, folder):
    old = log(spark, 100)
    _, paths = compared(spark, folder, old, old.limit(0), most=0)
    assert snapshots.differing_nodes(spark, *paths, most=0) is None


def test_nulls_repeats_negative_ids_and_moved_values(spark, folder):
    schema = "event_id long, user_id string, action string"
    old = [(None, "a", None), (None, "a", None), (-5, "a", None), (-5, "a", None), (1, "ab", "c"), (2, None, "-")]
    new = [(None, "a", None), (None, None, "a"), (-5, "a", None), (1, "a", "bc"), (2, "-", None)]
    found, _ = compared(spark, folder, spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert found.count() == 4


def test_other_columns_and_other_ranges(spark, folder):
    old = log(spark, 200)
    more = edited(old).select(F.lit(1).alias("added"), *reversed(old.columns))
    compared(spark, folder, old, more.select(*old.columns, "added"), bits=(6, 3))


def test_keys_must_be_whole_numbers(spark, folder):
    with pytest.raises(TypeError):
        snapshots.write_snapshot(log(spark, 5), folder("x"), key="user_id")
