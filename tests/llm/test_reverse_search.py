"""Reversed search against a plain ranking of all documents for each item."""

import math
import random
import re

import pytest

from casemill.llm import reverse_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    out = []
    for item, text in items:
        scores = []
        for doc, found in own:
            score = 0
            for term in set(terms(text)):
                tf = found.count(term)
                if tf:
                    df = sum(term in t for _, t in own)
                    m = 10 + 90 * len(found) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def tables(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "ÜNDER", "a-b", "x1y", " ", "é"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(300)]
    docs += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, None), (400, ""), (401, "!?"), (-7, "w1 " * 70_000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(30)]
    items += [(3, "w1 W1 w2"), (None, "w3"), (50, None), (51, ""), (52, "none of these")]
    df = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in docs], "doc_id long, text string, n int, terms string, item int").repartition(6)
    return docs, items, df, spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, block int, size int")


@pytest.mark.parametrize("k, block_bytes", [(10, 1 << 24), (3, 60)])
def test_equals_a_plain_ranking(spark, k, block_bytes):
    docs, items, df, asked = tables(spark)
    got = reverse_search.searched(df, asked, k=k, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items, k)


def test_no_rows(spark):
    _, _, df, asked = tables(spark)
    assert reverse_search.searched(df.limit(0), asked).count() == 0
    assert reverse_search.searched(df, asked.limit(0)).count() == 0
