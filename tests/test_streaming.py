"""Bounded streaming runs: late rows, state across micro-batches, each file once."""

import random

from pyspark.sql import functions as F
from test_properties import _throttle

from casemill.operators import directory
from casemill.streaming import events as streams, files
from casemill.workload import sources


START_MICROS = 1_704_067_200_000_000


def arrive(spark, path, rows, schema):
    stamped = spark.createDataFrame(rows, schema).withColumn(
        "ts", F.timestamp_micros((F.round(F.col("s") * 1_000_000)).cast("long") + START_MICROS)
    )
    stamped.coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def test_rows_beyond_the_watermark_are_dropped(spark, folder):
    path = folder("in")
    hour = 3600
    arrive(spark, path, [(1, 10.0), (1, 20.0), (1, 26.0 * hour)], "user_id long, s double")
    arrive(spark, path, [(1, 30.0 * hour)], "user_id long, s double")
    arrive(spark, path, [(1, 30.0), (1, 30.5 * hour)], "user_id long, s double")  # the first one is a day late
    rows = files.run_updates(
        streams.volume_stream(source(spark, path), window="1 day", lateness="1 hour"),
        ["period_start", "period_end"], folder("out"), folder("check"),
    ).orderBy("period_start").collect()
    assert [r["count"] for r in rows] == [2, 3]


def test_sessions_close_after_a_gap(spark, folder):
    path = folder("in")
    arrive(spark, path, [(1, 0.0), (1, 600.0), (1, 5000.0), (2, 100.0)], "user_id long, s double")
    arrive(spark, path, [(9, 90000.0)], "user_id long, s double")
    arrive(spark, path, [(9, 190000.0)], "user_id long, s double")
    out = files.run_to_table(streams.session_stream(source(spark, path)), folder("out"), folder("check"))
    found = sorted((r.user_id, r["count"]) for r in out.collect() if r.user_id != 9)
    assert found == [(1, 1), (1, 2), (2, 1)]


def test_throttle_stream_equals_batch_rule(spark, folder):
    rng, at, events = random.Random(2), 0.0, []
    for i in range(900):
        at += rng.choice([0.0, 1.0, 4.0, 30.0]) * rng.random()
        events.append((rng.choice([1, 1, 2]), round(at, 3), i))
    path = folder("in")
    for part in (events[:300], events[300:500], events[500:]):
        arrive(spark, path, [(k, t, i) for k, t, i in part], "sender long, s double, send_id long")
    stream = source(spark, path).withColumnRenamed("ts", "sent_at").select("sender", "send_id", "sent_at")
    out = files.run_to_table(streams.throttle_stream(stream, limit=6), folder("out"), folder("check"))
    assert {r.send_id: r.accepted for r in out.collect()} == _throttle(events, 6, 60)


def test_request_state_survives_batches(spark, folder):
    path = folder("in")
    schema = "request_id long, attempt_id long, target_state string, role string, justification string, expected_version long, s double"
    why = "a long enough reason"
    arrive(spark, path, [(1, 1, "En_Revision", "ANALYST", why, None, 1.0)], schema)
    arrive(spark, path, [(1, 2, "Aprobada", "VP_APPROVER", why, 2, 2.0), (2, 3, "Aprobada", "VP_APPROVER", why, None, 2.0)], schema)
    stream = source(spark, path).withColumnRenamed("ts", "attempted_at")
    out = files.run_to_table(streams.request_state_stream(stream), folder("out"), folder("check"))
    found = {r.attempt_id: (r.code, r.state, r.version) for r in out.collect()}
    assert found == {1: (200, "En_Revision", 2), 2: (200, "Aprobada", 3), 3: (409, "Solicitada", 1)}


def test_files_are_ingested_once(spark, sf, folder):
    raw = sources._raw(spark, sf).withColumns({"causa": F.lit("a"), "canal_atencion": F.lit("b"), "empresa": F.lit("c"), "tipo_pqr": F.lit("queja")})
    raw.repartition(3).write.json(folder("in"))

    def run():
        files.ingest_files(
            spark, folder("in"), raw.schema, folder("curated"), folder("bad"), folder("check"), min_date="2017-01-01", max_files=2
        ).awaitTermination()
        return spark.read.parquet(folder("curated")).count() + spark.read.parquet(folder("bad")).count()

    assert run() == raw.count() == run()
    raw.limit(5).coalesce(1).write.mode("append").json(folder("in"))
    assert run() == raw.count() + 5


def test_late_sends_get_an_outcome(spark, folder):
    path = folder("in")
    schema = "sender long, s double, send_id long"
    arrive(spark, path, [(1, 0.0, 1), (1, 1.0, 2), (1, 600.0, 3)], schema)
    arrive(spark, path, [(1, 700.0, 4)], schema)
    arrive(spark, path, [(1, 2.0, 5), (2, 3.0, 6), (1, 701.0, 7), (1, 702.0, 8)], schema)
    arrive(spark, path, [(2, 4.0, 9), (2, 703.0, 10)], schema)
    stream = source(spark, path).withColumnRenamed("ts", "sent_at").select("sender", "send_id", "sent_at")
    out = files.run_to_table(streams.throttle_stream(stream, limit=2), folder("out"), folder("check"))
    found = {r.send_id: (r.accepted, r.outcome) for r in out.collect()}
    sent, late = (True, "sent"), (False, "late")
    assert found == {1: sent, 2: sent, 3: sent, 4: sent, 5: late, 6: late, 7: sent, 8: (False, "throttled"), 9: late, 10: sent}


def test_repeated_ids_do_not_reach_the_curated_table(spark, sf, folder):
    raw = sources._raw(spark, sf).withColumns({"causa": F.lit("a"), "canal_atencion": F.lit("b"), "empresa": F.lit("c"), "tipo_pqr": F.lit("queja")})
    one = raw.dropDuplicates(["id_pqr"]).limit(50)

    def run(rows):
        rows.coalesce(1).write.mode("append").json(folder("in"))
        files.ingest_files(
            spark, folder("in"), raw.schema, folder("curated"), folder("bad"), folder("check"), min_date="1900-01-01"
        ).awaitTermination()
        found = spark.read.parquet(folder("curated"))
        return found.count(), found.select("case_id").distinct().count(), spark.read.parquet(folder("bad")).count()

    kept, ids, lost = run(one)
    assert kept == ids > 0 and kept + lost == 50
    assert run(one) == (kept, kept, lost + 50)
    assert run(raw.where("id_pqr IS NOT NULL").limit(1).union(raw.where("id_pqr IS NOT NULL").limit(1)))[:2] == (kept, kept)


def test_sends_without_a_time_are_refused(spark, folder):
    path = folder("in")
    schema = "sender long, s double, send_id long"
    first = [(1, 0.0, 1), (1, None, 2), (1, 1.0, 3), (2, None, 4)]
    second = [(1, None, 5), (1, 2.0, 6), (1, 3.0, 7), (2, 4.0, 8)]
    for rows in (first, second):
        arrive(spark, path, rows, schema)
    stream = source(spark, path).withColumnRenamed("ts", "sent_at").select("sender", "send_id", "sent_at")
    out = files.run_to_table(streams.throttle_stream(stream, limit=3), folder("out"), folder("check"))
    found = {r.send_id: (r.accepted, r.outcome) for r in out.collect()}
    sent, untimed = (True, "sent"), (False, "no_time")
    assert found == {1: sent, 2: untimed, 3: sent, 4: untimed, 5: untimed, 6: sent, 7: (False, "throttled"), 8: sent}

    log = spark.read.parquet(path).withColumnRenamed("ts", "sent_at").withColumn("recipient", F.lit("a@b.co"))
    known = spark.createDataFrame([("a@b.co", directory.ACTIVE)], "email string, status string")
    batch = directory.send_outcomes(log, known, limit=3)
    assert {r.send_id: r.outcome for r in batch.collect()} == {i: outcome for i, (_, outcome) in found.items()}
