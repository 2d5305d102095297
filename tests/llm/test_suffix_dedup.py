import hashlib
import random

import numpy as np
import pytest

from casemill.llm import suffix_dedup


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted((i, (t or "").encode()) for i, t in rows):
        covered = bytearray(len(text))
        for p in range(len(text) - length + 1):
            piece = text[p : p + length]
            if piece in seen:
                covered[p : p + length] = b"\x01" * length
            seen.add(piece)
        kept = bytes(c for c, gone in zip(text, covered) if not gone)
        spans = [p for p in range(len(text)) if covered[p] and not (p and covered[p - 1])]
        out[i] = (len(text), sum(covered), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def digest(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("length,seed,stretch,block", [(100, 24, 16, 1 << 24), (12, 4, 3, 200), (20, 5, 4, 1000)])
def test_equals_brute_force(spark, length, seed, stretch, block):
    rnd = random.Random(length)
    alphabet = "abcé" if length < 100 else "abcdefgh ü"
    make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    shared = [make(rnd.randint(length // 2, 3 * length)) for _ in range(6)]
    rows = [None, "", "short", make(length), "z" * 700, "xy" * 300]
    for _ in range(40):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else make(rnd.randint(0, length)) for _ in range(5)]
        text = "".join(parts)
        cut = rnd.randint(0, len(text))
        rows += [text, text[:cut] + "q" + text[cut:]] if rnd.random() < 0.3 else [text]
    rows += [rows[10]] * 4
    ids = rnd.sample(range(10**6), len(rows))
    data = list(zip(ids, rows))
    docs = spark.createDataFrame([(i, t, t) for i, t in data], "doc_id long, text string, spans string")
    found = suffix_dedup.deduplicated(docs, length=length, seed=seed, stretch=stretch, block_bytes=block)
    assert digest(found) == brute(data, length)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 64)
    parts = list(suffix_dedup._segments([b"0123456789" * 30, b"", b"x" * 64], 20))
    assert [r for r, _, _ in parts] == [0] * 5 + [1, 2]
    starts = {o + p for r, o, b in parts if r == 0 for p in range(len(b) - 19)}
    assert starts == set(range(281))


def test_ids_text_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(150))
    docs = spark.createDataFrame([(None, text), (2, text), (1, text + "é"), (2, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_dedup.deduplicated(docs, with_text=True).collect()}
    assert len(found) == 3 and found[None].n_removed == 0 and found[None].kept_text == text
    assert found[2].kept_text == "" and found[1].kept_text == text + "é" or found[1].n_removed > 0
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_merged_spans():
    ids, start, stop = (np.array(x) for x in ([1, 1, 1, 2, 2], [0, 5, 20, 0, 3], [5, 9, 22, 4, 6]))
    assert [x.tolist() for x in suffix_dedup.merged_spans(ids, start, stop)] == [[1, 1, 2], [0, 20, 0], [9, 22, 6]]


def test_pack_round_trip():
    a, b = np.array([1, -5, 2**62]), np.array([0, 7, 9])
    assert suffix_dedup.unpack(suffix_dedup.pack(a, b), 2).tolist() == [a.tolist(), b.tolist()]
