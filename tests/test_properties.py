"""Invariants, and exact results against brute force on small random tables."""

import hashlib
import random
from collections import Counter, deque
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from casemill.functions import special
from casemill.functions.numbers import round_to
from casemill.functions.quantiles import exact_quantiles, value_counts, with_ranks
from casemill.functions.severity import alert_level
from casemill.operators import charts, directory, pareto, privacy, profiling, requests, risk, statistics

SPARK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
finite = st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)


@SPARK
@given(values=st.lists(finite, min_size=1, max_size=100))
def test_quantiles_match_linear_interpolation(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    row = exact_quantiles(df, "v", probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-9)


def test_quantiles_per_group_with_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1000)) for _ in range(3000)] + [(f"g{i % 5}", float(i % 11)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in exact_quantiles(df, "v", {"q": 0.37, "m": 0.5}, ["g"]).collect()}
    for g in found:
        values = [v for k, v in rows if k == g]
        assert found[g].q == pytest.approx(float(np.quantile(values, 0.37)))
        assert found[g].m == pytest.approx(float(np.median(values)))


def test_ranks_count_smaller_rows(spark):
    values = [random.Random(5).choice([-3.5, -1.0, 0.0, 2.0, 2.0, 7.25, 1e5]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in with_ranks(value_counts(df, "x")).collect():
        assert (r.before, r.n, r.total) == (sum(v < r.v for v in values), values.count(r.v), len(values))


@SPARK
@given(texts=st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_mask_rules(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", "t", privacy.mask(F.col("t")).alias("m")).collect():
        if not r.t:
            assert r.m == r.t
        elif len(r.t) < 3:
            assert r.m == hashlib.sha256(r.t.encode()).hexdigest()[:8]
        else:
            assert r.m == r.t[0] + "*" * (len(r.t) - 2) + r.t[-1]


@SPARK
@given(pairs=st.lists(st.tuples(st.integers(0, 500), st.integers(1, 500)), min_size=1, max_size=30))
def test_wilson_bounds(spark, pairs):
    rows = [(min(k, n), n) for k, n in pairs]
    for r in statistics.wilson_interval(spark.createDataFrame(rows, "k int, n int"), "k", "n").collect():
        assert 0.0 <= r.lower <= r.k / r.n + 1e-12 and r.k / r.n - 1e-12 <= r.upper <= 1.0


@SPARK
@given(loads=st.lists(st.floats(0, 300), min_size=2, max_size=30))
def test_alert_level_grows_with_load(spark, loads):
    order = {"green": 0, "yellow": 1, "orange": 2, "red": 3}
    df = spark.createDataFrame([(v,) for v in sorted(loads)], "u double")
    levels = [order[r[1]] for r in sorted(df.select("u", alert_level(F.col("u"))).collect())]
    assert levels == sorted(levels)


@SPARK
@given(sizes=st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_pareto_invariants(spark, sizes):
    rows = [(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "cause string")
    shown = pareto.pareto(df).collect()
    assert {r.cause for r in shown} == {f"g{i}" for i, n in enumerate(sizes) if n >= 5}
    if shown:
        assert shown[-1].cumulative_pct == 100.0
        assert sum(r.high_concentration for r in shown) <= 1
    strict = pareto.pareto_table(df).collect()
    assert sum(r["count"] for r in strict) == sum(sizes) and strict[-1].cumulative_proportion == 1.0
    core = pareto.pareto_core(df).collect()
    kept = sum(r["count"] for r in core)
    assert kept / sum(sizes) >= 0.8 and (kept - core[-1]["count"]) / sum(sizes) < 0.8
    assert sum(r["count"] for r in pareto.executive_pareto(df, min_group=1).collect()) == sum(sizes)
    assert {r.category for r in charts.distribution(df, "cause").collect()} == {r.cause for r in shown}


def _throttle(events, limit, seconds):
    windows, out = {}, {}
    for key, at, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        w = windows.setdefault(key, deque())
        while w and w[0] <= at - seconds:
            w.popleft()
        out[i] = len(w) < limit
        if out[i]:
            w.append(at)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_throttle_against_brute_force(spark, seed):
    rng = random.Random(seed)
    events, at = [], 0.0
    for i in range(1500):
        at += rng.choice([0.0, 0.5, 3.0, 20.0, 200.0]) * rng.random()
        events.append((rng.choice([1, 1, 1, 2, 3]), round(at, 3), i))
    df = spark.createDataFrame([(k, t, i) for k, t, i in events], "k long, t double, i long").withColumn(
        "at", F.timestamp_micros((F.round(F.col("t") * 1_000_000)).cast("long"))
    )
    found = {r.i: r.accepted for r in directory.throttled(df, "k", "at", "i", limit=7).collect()}
    expected = _throttle(events, 7, 60)
    assert found == expected and not all(expected.values())


def test_replay_against_brute_force(spark):
    rng = random.Random(9)
    roles = ["SYSTEM_ADMIN", "ANALYST", "LEGAL_APPROVER", "OPERATIONS_LEAD", "AUDITOR", "NOBODY"]
    log = [
        (rng.choice([0, 0, 0, 1, 2]), i, rng.choice(requests.STATES), rng.choice(roles),
         rng.choice(["short", "a long enough reason"]), rng.choice([None, 1, 2, 3]))
        for i in range(600)
    ]
    schema = "request_id long, attempt_id long, target_state string, role string, justification string, expected_version long"
    df = spark.createDataFrame(log, schema).withColumn("attempted_at", F.timestamp_seconds("attempt_id"))
    found = {r.attempt_id: (r.code, r.state, r.version) for r in requests.replay_transitions(df).collect()}
    now: dict = {}
    for request, i, target, role, why, version in log:
        state, v = now.get(request, ("Solicitada", 1))
        allowed = requests.TRANSITIONS.get((state, target))
        if role == "NOBODY":
            code = 403
        elif len(why) < 10:
            code = 400
        elif role in requests.NEVER_CHANGE:
            code = 403
        elif version is not None and version != v:
            code = 409
        elif state in requests.TERMINAL or allowed is None:
            code = 409
        else:
            code = 200 if role in allowed else 403
        if code == 200:
            state, v = target, v + 1
        now[request] = (state, v)
        assert found[i] == (code, state, v)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def _ratio(a, b):
    return 1.0 if not a and not b else 1.0 - _distance(a, b) / max(len(a), len(b))


@pytest.mark.parametrize(("seed", "ratio"), [(1, 0.85), (2, 0.85), (3, 0.7)])
def test_similar_names_against_all_pairs(spark, seed, ratio):
    rng = random.Random(seed)
    names = set()
    while len(names) < 60:
        base = "".join(rng.choice("abc") for _ in range(rng.randint(1, 24)))
        names.add(base)
        for _ in range(2):
            at = rng.randrange(len(base))
            names.add(rng.choice([base[:at] + base[at + 1 :], base[:at] + "z" + base[at:], base[:at] + "y" + base[at + 1 :]]))
    names = sorted(n for n in names if n)
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(names, 2):
        if _ratio(a, b) >= ratio:
            parent[root(a)] = root(b)
    groups: dict = {}
    for n in names:
        groups.setdefault(root(n), set()).add(n)
    expected = {
        frozenset(g): np.mean([_ratio(a, b) for a, b in combinations(sorted(g), 2)]) for g in groups.values() if len(g) > 1
    }
    found: dict = {}
    for r in profiling.similar_values(spark.createDataFrame([(n,) for n in names], "c string"), "c", ratio).collect():
        found.setdefault(r.component, [set(), r.similarity_score])[0].add(r.value)
    assert {frozenset(g) for g, _ in found.values()} == set(expected)
    for g, score in found.values():
        assert score == pytest.approx(expected[frozenset(g)], abs=1e-4)


def test_scores_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(profiling, "_BLOCK", 3)
    names = [f"category number {i:02d}" for i in range(17)]
    rows = profiling.similar_values(spark.createDataFrame([(n,) for n in names], "c string"), "c").collect()
    mean = np.mean([_ratio(a, b) for a, b in combinations(names, 2)])
    assert len(rows) == 17 and rows[0].similarity_score == pytest.approx(mean, abs=1e-4)


def test_components_of_long_chain(spark):
    nodes = [f"n{i:03d}" for i in range(60)]
    rng = random.Random(1)
    edges = list(zip(nodes, nodes[1:])) + [("p", "q")]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string")
    labels = {r.node: r.component for r in profiling.connected_components(df).collect()}
    assert {labels[n] for n in nodes} == {"n000"} and labels["q"] == "p"


def _direct_shapiro(xs):
    xs, n = sorted(xs), len(xs)
    m = special.normal_score(np.arange(1, n + 1), n)
    x = np.array(xs)
    return special.shapiro_finish(
        n, float((m * m).sum()), float((m * x).sum()), xs[-1] - xs[0], xs[-2] - xs[1], float(((x - x.mean()) ** 2).sum())
    )


@pytest.mark.parametrize("n", [5, 6, 11, 12, 40, 700, 4000])
def test_shapiro_from_counts_matches_rows(spark, n):
    rng = random.Random(n)
    xs = [round(rng.expovariate(1.0), 2) for _ in range(n)]
    row = statistics.shapiro_wilk(spark.createDataFrame([(x,) for x in xs], "v double"), "v").first()
    w, p = _direct_shapiro(xs)
    assert row.statistic == pytest.approx(w, abs=1.01e-4) and row.p_value == pytest.approx(p, abs=1e-3)


def test_auc_against_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.3, round(rng.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame([(int(y), int(s > 0.5), s, 1.0) for y, s in rows], "label int, prediction int, score double, n double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert risk.evaluate(df).first().roc_auc == pytest.approx(auc, abs=1e-4)


@SPARK
@given(values=st.lists(st.integers(0, 6), min_size=1, max_size=60))
def test_chi_square_against_grid(spark, values):
    pairs = [(f"r{v % 3}", f"c{(v * v) % 4}") for v in values]
    row = statistics.chi_square_statistic(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    o, n = Counter(pairs), len(pairs)
    r, c = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    dof = (len(r) - 1) * (len(c) - 1)
    direct = 0.0
    for a in r:
        for b in c:
            e = r[a] * c[b] / n
            gap = abs(o[(a, b)] - e)
            gap -= min(0.5, gap) if dof == 1 else 0.0
            direct += gap * gap / e if dof else 0.0
    assert row.degrees_of_freedom == dof and row.statistic == pytest.approx(direct, abs=1e-8)


def test_rounding_helper(spark):
    row = spark.createDataFrame([(2.345, -2.5)], "a double, b double").select(
        round_to(F.col("a"), 2).alias("a"), round_to(F.col("b"), 0).alias("b")
    ).first()
    assert (row.a, row.b) == (2.35, -3.0)
