import itertools
import random
import re

import pytest

from casemill.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def near(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block,bucket", [(3, 400), (512, 1 << 24)])
def test_equals_brute_force(spark, block, bucket):
    rnd = random.Random(block)
    rows, passage = [], " ".join(f"p{i}" for i in range(60))
    for _ in range(6):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice((30, 80, 150)))]
        rows += [near(rnd, base, rnd.randrange(0, 8)) for _ in range(rnd.choice((1, 3, 14)))]
        rows.append(" ".join(base) + " " + passage)
    chain = [f"c{i}" for i in range(120)]
    rows += [" ".join(chain[i : i + 60]) for i in range(0, 60, 6)]
    rows += [None, "", " \n", "one two", "ONE two", "one", "a b c d e", "A b c d e", "x " * 3000, rows[0], rows[0].upper()]
    rnd.shuffle(rows)
    data = [(i * 3 % 1009, t, i) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n int")
    found = jaccard_join.joined(docs, block_classes=block, bucket_bytes=bucket)
    assert sorted(map(tuple, found.collect())) == brute([(i, t) for i, t, _ in data])


def test_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    found = sorted(map(tuple, jaccard_join.joined(docs).collect()), key=str)
    assert found == [(2, 2, 2), (2, 2, 2), (5, 2, 2), (None, 2, None)]
    assert jaccard_join.joined(docs.limit(0)).count() == 0
    assert [tuple(r) for r in jaccard_join.joined(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = dict(map(tuple, jaccard_join.components(links).collect()))
    assert {found[i] for i in range(41)} == {0} and found[101] == 100
