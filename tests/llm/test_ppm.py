"""Language-model scores against a byte-by-byte trie, and edge cases."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casemill.llm import ppm

K = ppm.ORDER


def padded(text):
    return bytes([ppm.START]) * K + (text or "").encode() + bytes([ppm.END])


class Trie:
    """Contexts with the counts of their symbols; shorter ones learn a symbol when the longer did not know it."""

    def __init__(self, texts):
        self.node = defaultdict(Counter)
        for raw in map(padded, texts):
            for i in range(K, len(raw)):
                for length in range(K, -1, -1):
                    context = raw[i - length : i]
                    new = raw[i] not in self.node[context]
                    self.node[context][raw[i]] += 1
                    if not new:
                        break

    def bits(self, raw, i):
        excluded, total = set(), 0.0
        for length in range(K, -1, -1):
            own = self.node.get(raw[i - length : i])
            if own is None:
                continue
            left = {s: c for s, c in own.items() if s not in excluded}
            t = sum(left.values())
            if raw[i] in left:
                return total + math.log10((2 * left[raw[i]] - 1) / (2 * t))
            if left:
                total += math.log10(len(left) / (2 * t))
            excluded = set(own)
        return total - math.log10(256 - len(self.node.get(b"", ())))

    def score(self, text):
        raw = padded(text)
        return sum(self.bits(raw, i) for i in range(K, len(raw)))


def base(texts, trained):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(w for t, own in zip(texts, trained) if own for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)))
        for t in texts
    ]


TEXTS = [
    "the cat sat on the mat", "the cat sat on the hat", "", None, "é ü ñ \x1c x", "a" * 3000, "The CAT", "\t\n ",
    "the cat sat on the mat", "zebra quilt", "ab\x0bcd  ef", "0" * 50 + " the", "mat on sat cat the",
]


@pytest.mark.parametrize("block_bytes", [1 << 24, 100])
def test_equals_trie(spark, block_bytes):
    rows = [(i, t, i % 3 != 1, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, own boolean, score string")
    trained = [r[2] for r in rows]
    trie = Trie([t for t, own in zip(TEXTS, trained) if own])
    found = {r.doc_id: r for r in ppm.scored(docs, F.col("own"), block_bytes=block_bytes).collect()}
    assert len(found) == len(TEXTS)
    for i, (text, expected) in enumerate(zip(TEXTS, base(TEXTS, trained))):
        row = found[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == expected[:3]
        assert row.base_score == pytest.approx(expected[3]) and row.score == pytest.approx(trie.score(text))


def test_probabilities_add_up(spark):
    trie = Trie(["abracadabra", "abab", "cada"])
    for context in (b"abrac", b"zzzzz", b"racad", bytes([ppm.START]) * K):
        symbols = [s for s in range(256)]
        total = sum(10 ** trie.bits(context + bytes([s]), K) for s in symbols)
        assert total == pytest.approx(1)


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id int, text string")
    found = sorted(ppm.scored(docs, F.lit(None).cast("boolean")).collect(), key=lambda r: r.n_tokens)
    assert [r.n_known for r in found] == [0, 0] and found[1].score == pytest.approx(-3 * math.log10(256))
    assert ppm.scored(docs.limit(0), F.lit(True)).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text")] * 5, "doc_id int, text string")
    assert len({(r.score, r.base_score) for r in ppm.scored(docs, F.lit(True)).collect()}) == 1


def test_query_holds_out_no_row_without_an_id(spark, tmp_path):
    from casemill.llm.queries import QUERIES

    spark.createDataFrame([(None, "a b"), (1, "a c"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.held_out for r in QUERIES["op3_lm_scores"](spark, str(tmp_path)).collect()}
    import zlib

    assert rows == {None: False, **{i: zlib.crc32(str(i).encode()) % 7 == 2 for i in (1, 2)}}
