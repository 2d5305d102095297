import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from casemill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins_of(counts):
    segments, n = packing.planned(np.array(counts))
    bins: dict[int, list] = {}
    for length, rank, pieces, first, per, offset in segments.tolist():
        for i in range(pieces):
            bins.setdefault(first + i // per, []).append((offset + i % per * length, length))
    assert set(bins) == set(range(n))
    return bins


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_a_packing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice((10, 37, 100))
    counts = [0] + [rnd.choice((0, 0, 1, 2, 7, 40)) for _ in range(capacity)]
    bins = bins_of(counts)
    seen = [0] * (capacity + 1)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
            seen[length] += 1
        assert at <= capacity
    assert seen == counts
    rooms: list[int] = []
    for length in (i for i in range(capacity, 0, -1) for _ in range(counts[i])):
        fits = [(room, at) for at, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    assert len(bins) <= len(rooms)


def optimum(items, capacity):
    best = len(items)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            place(rest[1:], rooms[:i] + [rooms[i] - rest[0]] + rooms[i + 1 :])
        place(rest[1:], [*rooms, capacity - rest[0]])

    place(sorted(items, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_reduction_loses_nothing(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(1, 12) for _ in range(rnd.randint(1, 8))]
    counts = np.bincount(items, minlength=13)
    plan = packing._Plan(counts)
    plan.reduce()
    rest = np.repeat(np.arange(13), plan.left).tolist()
    assert plan.sequences + (optimum(rest, 12) if rest else 0) == optimum(items, 12)


def test_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello, World's  END\t<|endoftext|>x", "née Ω ΣΑΣ '", "the cat " * 700, "a" * 3000, "same", "same", "é x"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    found = packing.packed(docs, PATH, capacity=256).collect()
    expected = []
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[a : a + 256], "<u4")
            expected.append((i if i != 3 else None, k, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in found)
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert packing.packed(docs.limit(0), PATH).count() == 0
