"""Best-fit packing of tokenised documents after a dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Equal lengths are interchangeable, so the packing
is decided on the histogram of lengths, which has at most ``capacity`` rows whatever the data holds:

1. Reduction: for the longest piece that is left, a set that provably dominates every alternative is fixed
   for as many pieces as there are: alone if nothing fits beside it; with a partner that fills the
   sequence; with the longest partner if only one fits; with the longest partner if two others fit but
   never hold more than it does.
2. The remainder is packed best fit, longest first, many equal pieces at a time.

Both give segments: the pieces of one length from one rank to another go to consecutive sequences at one
offset. Spark ranks the pieces inside their length without holding a length in one task, and every piece
reads its place from its segment.

Defined results: a null text is an empty one; an empty text is one piece that holds the end id; repeated
rows and null ids are packed like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from casemill.llm.running import shuffle_key, with_running_sum
from casemill.llm.words import text_chunks, word_lists
from casemill.session import durable

CAPACITY = 4096
END_ID = 1
#: Words a task remembers; beyond it the memory is emptied, which changes nothing but speed.
REMEMBERED_WORDS = 400_000


#: Words of letters that are tokenised as one text.
JOINED_WORDS = 1000
#: Marks that end a word without touching its ids.
_TAILS = (".", ",")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, and which of its ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    if suffix:
        ends[[number for entry, number in tokenizer.get_vocab().items() if entry.endswith(suffix)]] = True
    return tokenizer, ends


def word_ids(words: list[str], path: str) -> list[np.ndarray]:
    """The ids of each word. Words of letters alone are one unit of the tokenizer each, so many of them are
    tokenised as one text and told apart by the ids that end a word; if these do not tell, or a word holds
    anything else, it is tokenised alone."""
    tokenizer, ends = _tokenizer(path)
    encode = lambda texts: [np.array(f.ids, np.uint32) for f in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
    alone = [i for i, w in enumerate(words) if not w.isalpha()]
    plain = [i for i, w in enumerate(words) if w.isalpha()]
    groups = [plain[at : at + JOINED_WORDS] for at in range(0, len(plain), JOINED_WORDS)]
    for group, ids in zip(groups, encode([" ".join(words[i] for i in group) for group in groups])):
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(group):
            alone += group
            continue
        for i, start, stop in zip(group, [0, *stops[:-1].tolist()], stops.tolist()):
            out[i] = ids[start:stop].copy()
    for i, ids in zip(alone, encode([words[i] for i in alone])):
        out[i] = ids
    return out


def token_ids(texts: pa.Array, path: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, number of ids per text). The tokenizer never looks across white space,
    ignores case and separates letters from marks, so every distinct word is tokenised once, without case
    and without a full stop or comma at its end."""
    words, ends = word_lists(texts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    bodies, tails = [], []
    for word in distinct:
        # Special tokens are told by their case, so a word that may hold one stays as it is.
        body = word if "<" in word else word.lower() if word.isascii() else word
        tail = body[-1] in _TAILS and body[:-1].isalpha()
        bodies.append(body[:-1] if tail else body)
        tails.append(body[-1] if tail else "")
    new = list(dict.fromkeys(w for w in (*bodies, *_TAILS) if w not in known))
    known.update(zip(new, word_ids(new, path)))
    parts = [np.concatenate([known[b], known[t]]) if t else known[b] for b, t in zip(bodies, tails)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate([np.zeros(0, np.uint32), *parts])
    first = np.cumsum(sizes) - sizes
    index = coded.indices.to_numpy()
    word_sizes = sizes[index]
    stop = np.cumsum(word_sizes)
    total = int(stop[-1]) if len(stop) else 0
    places = np.arange(total) + np.repeat(first[index] - (stop - word_sizes), word_sizes)
    per_text = np.diff(np.r_[0, stop][ends], prepend=0)
    return flat[places], per_text


@lru_cache(maxsize=2)
def _remembered(path: str) -> dict[str, np.ndarray]:
    """What this worker process has tokenised so far, across its tasks."""
    return {}


def _cut(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(path)
        for batch in batches:
            texts = batch["text"]
            for start, stop in text_chunks(texts):
                ids, sizes = token_ids(texts.slice(start, stop - start), path, known)
                rows, pieces, crcs, lengths = [], [], [], []
                at = 0
                for row, size in enumerate(sizes.tolist()):
                    own = np.append(ids[at : at + size], np.uint32(end_id)).astype("<u4")
                    at += size
                    for piece, first in enumerate(range(0, len(own), capacity)):
                        part = own[first : first + capacity]
                        rows.append(row)
                        pieces.append(piece)
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(start, stop - start).take(pa.array(rows, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array(np.array(pieces, np.int64) * capacity, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


class _Plan:
    """Segments: (length, first rank, pieces, first sequence, pieces per sequence, offset)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.copy()
        self.capacity = len(counts) - 1
        self.given = np.zeros_like(counts)
        self.sequences = 0
        self.segments: list[tuple[int, ...]] = []

    def place(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.segments.append((length, int(self.given[length]), n, sequence, per, offset))
        self.given[length] += n
        self.left[length] -= n

    def fix(self, lengths: list[int], times: int) -> None:
        offset = 0
        for length in lengths:
            self.place(length, times, self.sequences, 1, offset)
            offset += length
        self.sequences += times

    def reduce(self) -> None:
        for longest in range(self.capacity, 0, -1):
            while self.left[longest] and self._fix_one(longest):
                pass

    def _fix_one(self, j: int) -> bool:
        others = self.left.copy()
        others[j] -= 1
        room = self.capacity - j
        fitting = np.flatnonzero(others[: room + 1])
        if not len(fitting):
            self.fix([j], int(self.left[j]))
            return True
        k = int(fitting[-1])
        smallest = np.repeat(fitting[:3], np.minimum(others[fitting[:3]], 3))[:3]
        alone = len(smallest) < 2 or smallest[:2].sum() > room
        if not (k == room or alone):
            three = len(smallest) == 3 and smallest.sum() <= room
            below = np.zeros(room + 1, np.int64)
            below[fitting] = fitting
            below = np.maximum.accumulate(below)
            pairs = fitting + below[room - fitting]
            held = pairs[below[room - fitting] > 0]
            if three or (len(held) and held.max() > k):
                return False
        self.fix([j, k], int(self.left[j] // 2 if j == k else min(self.left[j], self.left[k])))
        return True

    def best_fit(self) -> None:
        open_bins: dict[int, list[tuple[int, int]]] = {}
        has_room = np.zeros(self.capacity + 1, bool)

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                open_bins.setdefault(room, []).append((first, n))
                has_room[room] = True

        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                rooms = np.flatnonzero(has_room[length:])
                if len(rooms):
                    room = int(rooms[0]) + length
                    first, bins = open_bins[room].pop()
                    has_room[room] = bool(open_bins[room])
                else:
                    room, first = self.capacity, self.sequences
                    bins = -(-n // (room // length))
                    self.sequences += bins
                per = room // length
                whole = min(bins, n // per)
                if whole:
                    self.place(length, whole * per, first, per, self.capacity - room)
                    add(room - whole_room(per, length), first, whole)
                rest = n - whole * per
                if whole < bins and rest:
                    self.place(length, rest, first + whole, rest, self.capacity - room)
                    add(room - whole_room(rest, length), first + whole, 1)
                    whole += 1
                add(room, first + whole, bins - whole)


def whole_room(pieces: int, length: int) -> int:
    return pieces * length


def planned(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Segments in order of (length, first rank), and the number of sequences, for ``counts[length]``."""
    plan = _Plan(counts)
    plan.reduce()
    plan.best_fit()
    return np.array(sorted(plan.segments), np.int64).reshape(-1, 6), plan.sequences


def _placed(segments: np.ndarray):
    # Ranks of a length are below 2**48, so (length, rank) is one sorted number.
    keys = segments[:, 0] << 48 | segments[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() - 1
            found = segments[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            step = rank - found[:, 1]
            sequence = found[:, 3] + step // found[:, 4]
            offset = found[:, 5] + step % found[:, 4] * length
            kept = [batch[c] for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return place


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _cut(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: in as few sequences as the packing finds."""
    cut = durable(pieces(docs, tokenizer, doc_id, text, capacity, end_id))
    counts = np.zeros(capacity + 1, np.int64)
    # One row per length, so at most ``capacity`` rows.
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    segments, _ = planned(counts)
    keyed = cut.withColumn("_key", shuffle_key(F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))).withColumn("_one", F.lit(1))
    ranked = with_running_sum(
        keyed, "length", "_key", "_one", "rank", ("doc_id", "piece", "ids_crc32"), n_rows=int(counts.sum())
    ).select(*cut.columns, "rank")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cut.schema)}, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(segments), schema)
