"""Replay of transition logs whose requests fill many ranges."""

import random

from pyspark.sql import functions as F

from casemill.operators import requests

SCHEMA = "request_id long, attempt_id long, target_state string, role string, justification string, expected_version long, at long"
WHY = "a long enough reason"


def frame(spark, rows):
    stamped = spark.createDataFrame(rows, SCHEMA).withColumn("attempted_at", F.timestamp_seconds("at"))
    return stamped.withColumn("note", F.col("attempt_id") + 2**60)  # other columns come back unchanged


def replayed(log):
    """The rule, one attempt after the other."""
    now, outcome = {}, {}
    first = lambda value: (value is not None, value)  # noqa: E731  nulls come first
    for request, i, target, role, why, version, at in sorted(log, key=lambda r: (first(r[6]), r[1])):
        state, v = now.get(request, ("Solicitada", 1))
        if role not in requests.ROLES:
            code = 403
        elif why is None or len(why) < requests.MIN_JUSTIFICATION:
            code = 400
        elif role in requests.NEVER_CHANGE:
            code = 403
        elif (version is not None and version != v) or state in requests.TERMINAL or (state, target) not in requests.TRANSITIONS:
            code = 409
        else:
            code = 200 if role in requests.TRANSITIONS[state, target] else 403
        if code == 200:
            state, v = now[request] = target, v + 1
        outcome[i] = (code, state, v)
    return outcome


def random_log(seed, n, ids, share):
    """Attempts, the given share of them able to succeed."""
    rng = random.Random(seed)
    roles = ["SYSTEM_ADMIN", "ANALYST", "LEGAL_APPROVER", "OPERATIONS_LEAD", "AUDITOR", "NOBODY", None]
    return [
        (rng.choice(ids), i, rng.choice([*requests.STATES, None]), rng.choice(roles),
         WHY if rng.random() < share else rng.choice(["short", None]), rng.choice([None, None, 1, 2, 3, 4]),
         rng.choice([i, i, i // 50, None]))
        for i in range(n)
    ]


def found(df):
    return {r.attempt_id: (r.code, r.state, r.version) for r in df.collect()}


def test_many_shapes_of_logs(spark):
    for seed, ids, share in ((1, [1], 0.02), (2, [1, 1, 1, 2, 3], 0.05), (3, [None, None, 5], 0.05), (4, list(range(300)), 0.6)):
        log = random_log(seed, 1500, ids, share)
        assert found(requests.replay_transitions(frame(spark, log))) == replayed(log), seed


def test_a_hot_request_changes_state_in_many_ranges(spark):
    # One request holds nearly all rows and changes at both ends, so every range depends on the ones before.
    steps = [("En_Revision", 1), ("Aprobada", 2000), ("En_Ejecucion", 3500), ("Cerrada", 3900)]
    log = [(7, i, "Cerrada", "SYSTEM_ADMIN", WHY, None if i % 3 else 1, i) for i in range(4000)]
    log = [r for r in log if r[1] not in {i for _, i in steps} and r[1] < 3900]
    log += [(7, i, state, "SYSTEM_ADMIN", WHY, None, i) for state, i in steps]
    log += [(9, 5000, "En_Revision", "ANALYST", WHY, 1, 1)]
    log = [r for r in log if not (r[2] == "Cerrada" and 3500 < r[1] < 3900)]
    dealt = requests._dealt(frame(spark, log))
    assert dealt.where("request_id = 7").select("_range").distinct().count() > 4
    assert found(requests.replay_transitions(frame(spark, log))) == replayed(log)
    assert replayed(log)[3900] == (200, "Cerrada", 5)


def test_the_log_is_read_and_moved_once(spark, folder):
    frame(spark, random_log(5, 50, [1, 2], 0.5)).write.parquet(folder("log"))
    plan = requests._dealt(spark.read.parquet(folder("log")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_columns_and_empty_logs(spark):
    df = frame(spark, random_log(6, 40, [1], 0.5))
    out = requests.replay_transitions(df)
    assert out.columns == [*df.columns, "code", "reason", "state", "version"]
    assert {(r.attempt_id, r.note) for r in out.collect()} == {(i, i + 2**60) for i in range(40)}
    assert requests.replay_transitions(df.where("false")).count() == 0


def test_repeated_attempts_change_a_request_once(spark):
    row = (1, 1, "En_Revision", "ANALYST", WHY, None, 1)
    codes = [r.code for r in requests.replay_transitions(frame(spark, [row] * 3)).collect()]
    assert sorted(codes) == [200, 409, 409]


def test_words_compose(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice(requests.LETTERS) for _ in requests.LETTERS) for _ in range(3)] + [requests.LETTERS]
    for a in words:
        for b in words:
            both = requests._compose(a, b)
            assert [both[i] for i in range(len(both))] == [b[requests.LETTERS.index(a[i])] for i in range(len(a))]
            row = spark.range(1).select(requests._led_by(F.lit("c"), F.lit(both)).alias("x")).first()
            assert row.x == both[2]
