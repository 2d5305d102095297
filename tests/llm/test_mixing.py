import pytest

from casemill.llm import mixing


def words(n):
    return "w " * n


def test_targets_fill_up_to_the_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 300), ("d", 0)], "source string, size long")
    found = {r.source: (r.source_size, r.target) for r in mixing.targets(sizes).collect()}
    # Budget 2115, weights 5 2 1 5 2; a, c and d are capped at 200, 20 and 0; b and null share 1895 by 2 and 2.
    assert found["a"] == (100, 200.0) and found["c"] == (10, 20.0) and found["d"] == (0, 0.0)
    assert found[None] == (300, 600.0) and found["b"][1] == pytest.approx(1295)


def test_mix(spark):
    rows = [(i, words(1 + i % 40), f"s{i % 4}", 0) for i in range(800)] + [(900 + i, words(30), None, 0) for i in range(400)]
    rows += [(2000, None, "s0", 0), (2001, "", "s1", 0), (None, words(5), "s2", 0), (7, words(8), "s3", 0), (7, words(8), "s3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows) and {r.copies for r in found} <= {0, 1, 2}
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    total = sum(r.size for r in found)
    taken: dict = {}
    for r in found:
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert total * 1.5 - 100 <= sum(taken.values()) <= total * 1.5
    for source, target in {(r.source, r.target) for r in found}:
        assert abs(taken[source] - target) <= 100
    assert {r.taken for r in found if r.doc_id in (2000, 2001)} == {0}


def test_one_source_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, source string")
    row = mixing.mixed(docs).first()
    assert (row.source_size, row.target, row.taken) == (2, 3.0, 2)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, None, "a")], docs.schema)).first().taken == 0
