"""Byte-level BPE: encoding and decoding of whole texts by a file of ranked byte strings.

1. A text is cut into words by the split pattern of the rank files (``SPLIT``), with the character classes of the
   tokeniser library itself, in array steps over the code points of many texts at once.
2. The words of a chunk of texts are numbered; a distinct word of a chunk is one row (chunk, place, word).
3. Equal words of all chunks meet, sorted, and the first of them is folded by Spark's higher-order functions: a word
   is its array of bytes, and each step of ``aggregate`` merges the leftmost adjacent pair of least rank, which a literal map tells. The
   ranks of the pairs beside a merge are looked up again, all others stay. Words of more than ``FOLD_BYTES`` bytes,
   for which a fold would move its array too often, take the same merges in the same order from a heap.
4. The other rows of a word take over its ids; they return to their chunks, where each text is the ids of its
   words in order.

What moves is the number of each word in its text and the distinct words of each chunk. Neither the words of
the corpus nor those of a text are collected or broadcast; a word that all chunks hold is a row per chunk, and
these stream by. Broadcast, or literal, is the vocabulary alone. A chunk is known by a digest of
its words: a task that runs again names it alike, and equal chunks share their answers.

Decoding concatenates the byte strings of the ids.

Defined results: a null or empty text has no ids; null or repeated document ids are encoded row by row; an empty
table gives no rows; other columns are ignored. Null ids decode to null, as do ids that the file does not hold.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from casemill.llm.words import text_chunks

#: Fixed value: the split pattern of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLD_BYTES = 256
CHUNK_BYTES = 32 << 20
#: Bytes of text that are cut at once, in arrays of some ten times that size.
PART_BYTES = 1 << 19
#: Maps of a few pairs each, found by their place in an array.
MAP_BUCKETS = 16381
_NONE = (1 << 31) - 1
_SHORT = 1 << 15
_LETTER, _NUMBER, _SPACE = 1, 2, 3


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings by rank from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(key): int(rank) for key, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def _packed_classes() -> bytes:
    """The class of every code point, as the tokeniser library sees it (its version of Unicode)."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    classes = np.zeros(0x110000, np.uint8)
    for value, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        matcher = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(matcher.encode_ordinary(every)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return zlib.compress(classes.tobytes())


def split_words(texts: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of words up to the end of each text), cut as ``SPLIT`` cuts."""
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(texts.buffers()[2][int(offsets[0]) : int(offsets[-1])])
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = classes[points]
    opens = np.zeros(n + 1, bool)
    opens[(ends - lengths)[lengths > 0]] = True
    opens[n] = True
    changed = np.r_[True, kind[1:] != kind[:-1]] | opens[:n]
    solid = kind != _SPACE
    starts = changed.copy()
    # The last white space before something else belongs to it if it is a space, and is a word of its own otherwise.
    led = np.flatnonzero(changed & solid & ~opens[:n])
    led = led[~solid[led - 1]]
    starts[led - 1] = True
    starts[led[points[led - 1] == 0x20]] = False
    # An apostrophe that no space leads takes one of the seven endings with it.
    quote = np.flatnonzero(starts & (points == 0x27))
    quote = quote[(quote + 1 < n)]
    quote = quote[~opens[quote + 1]]
    one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
    second = np.minimum(quote + 2, n - 1)
    pair = points[quote + 1].astype(np.int64) << 32 | points[second]
    two = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]) & (quote + 2 < n) & ~opens[np.minimum(quote + 2, n)]
    for at, length in ((quote[one], 1), (quote[two], 2)):
        starts[at + 1] = False
        after = at + 1 + length
        after = after[after < n]
        starts[after[kind[after] == _LETTER]] = True
    places = np.flatnonzero(starts)
    widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    upto = np.r_[0, np.cumsum(widths)]
    cuts = np.r_[upto[places], len(data)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return words, np.searchsorted(places, ends)


def _numbered(batches: Iterator[pa.RecordBatch], packed: bytes, chunk_bytes: int):
    """Chunks of texts as (document ids, words up to the end of each, number of each word, distinct words)."""
    classes = np.frombuffer(zlib.decompress(packed), np.uint8)
    ids, counts, words, held = [], [], [], 0

    def chunk():
        coded = pa.chunked_array(words, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries()
        codes = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)])
        distinct = coded.chunks[0].dictionary if coded.num_chunks else pa.array([], pa.binary())
        # Frequent words get small numbers, which take less room.
        order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        return pa.concat_arrays(ids), np.concatenate(counts), number[codes], distinct.take(pa.array(order))

    for batch in batches:
        for start, stop in text_chunks(batch["text"], PART_BYTES):
            texts = batch["text"].slice(start, stop - start)
            found, upto = split_words(texts, classes)
            ids.append(batch["doc_id"].slice(start, stop - start))
            counts.append(np.diff(upto, prepend=0))
            words.append(found.dictionary_encode())
            held += pc.sum(pc.binary_length(texts)).as_py() or 0
            if held >= chunk_bytes:
                yield chunk()
                ids, counts, words, held = [], [], [], 0
    if ids:
        yield chunk()


def _key(distinct: pa.Array) -> int:
    """A digest of a chunk's words; their array is one that ``take`` has made."""
    if not len(distinct):
        return 0
    cuts = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1]
    digest = hashlib.blake2b(cuts.tobytes(), digest_size=8)
    digest.update(distinct.buffers()[2][: int(cuts[-1])])
    return int.from_bytes(digest.digest(), "little", signed=True)


def _words_of(packed: bytes, ranks: dict[bytes, int], fold_bytes: int, chunk_bytes: int):
    """Distinct words of each chunk; a word too long to fold is known by its digest and has its ids."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, distinct in _numbered(batches, packed, chunk_bytes):
            key = _key(distinct)
            long = pc.greater(pc.binary_length(distinct), fold_bytes).to_numpy(zero_copy_only=False)
            for start in range(0, len(distinct), 1 << 16):
                part = distinct.slice(start, 1 << 16)
                ids: list[list[int] | None] = [None] * len(part)
                places = np.flatnonzero(long[start : start + len(part)])
                if len(places):
                    names = part.to_pylist()
                    for at in places.tolist():
                        names[at], ids[at] = hashlib.sha512(names[at]).digest(), merged_by_heap(names[at], ranks)
                    part = pa.array(names, pa.binary())
                columns = [
                    pa.array(np.full(len(part), key), pa.int64()), pa.array(np.arange(start, start + len(part)), pa.int32()), part,
                    pa.array(ids, pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "word", "own"])

    return words_of


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as a byte each, with those from 255 on, in four planes, behind them."""
    rare = numbers[numbers >= 255].astype(np.uint32)
    data = np.minimum(numbers, 255).astype(np.uint8).tobytes() + np.ascontiguousarray(rare.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _numbers(blob: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    numbers = data[:n].astype(np.uint32)
    numbers[numbers == 255] = np.ascontiguousarray(data[n:].reshape(4, -1).T).view(np.uint32).ravel()
    return numbers


def _texts_of(packed: bytes, chunk_bytes: int):
    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, codes, distinct in _numbered(batches, packed, chunk_bytes):
            row = [
                pa.array([_key(distinct)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
                pa.array([_squeezed(codes)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(row, names=["chunk", "docs", "counts", "codes"])

    return texts_of


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the id of both together, for every cut of every byte string into two known ones."""
    pairs = {}
    for whole, rank in ranks.items():
        for at in range(1, len(whole)):
            left, right = ranks.get(whole[:at]), ranks.get(whole[at:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    return pairs


def folded(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word (binary, not empty) by ranked merges, as one expression without user functions."""
    bits = max(ranks.values()).bit_length()
    buckets: list[dict[str, int]] = [{} for _ in range(MAP_BUCKETS)]
    for (left, right), rank in pair_ranks(ranks).items():
        buckets[(left << bits | right) % MAP_BUCKETS][str(left << bits | right)] = rank
    # Both are literals once the plan is optimised; the larger one stands there once and is bound to a name.
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>").cast("array<map<bigint,int>>")
    singles = F.split(F.lit(" ".join(str(ranks[bytes([b])]) for b in range(256))), " ").cast("array<int>")

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def key(left: Column, right: Column) -> Column:
        return F.shiftleft(left.cast("bigint"), bits) + right

    def merges(known: Column) -> Column:
        def rank_of(pair: Column) -> Column:
            return F.coalesce(F.element_at(F.get(known, F.pmod(pair, F.lit(MAP_BUCKETS)).cast("int")), pair), F.lit(_NONE))

        def pending(ids: Column, own: Column) -> Column:
            """The state: pieces, ranks of adjacent pairs, the least of these and its place."""

            def of(looked: Column) -> Column:
                best = F.array_min(looked)
                return F.struct(ids.alias("ids"), looked.alias("ranks"), best.alias("best"), F.array_position(looked, best).cast("int").alias("at"))

            return let(own, of)

        def step(state: Column, _: Column) -> Column:
            ids, own, best, at = (state[name] for name in ("ids", "ranks", "best", "at"))
            left = F.when(at > 1, F.array(rank_of(key(F.get(ids, at - 2), best)))).otherwise(nothing)
            right = F.when(at < F.size(own), F.array(rank_of(key(best, F.get(ids, at + 1))))).otherwise(nothing)
            merged = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, F.size(own)))
            ranks_left = F.slice(own, F.lit(1), F.greatest(at - 2, F.lit(0)))
            after = pending(merged, F.concat(ranks_left, left, right, F.slice(own, at + 2, F.size(own))))
            return F.when(best < _NONE, after).otherwise(state)

        nothing = F.array().cast("array<int>")
        text = F.hex(word)
        n = F.octet_length(word)
        single = F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(singles, F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
        )

        def start(ids: Column) -> Column:
            every = F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n - 1), lambda a, b: rank_of(key(a, b)))
            return pending(ids, every)

        # A word of one byte takes no step: with no pair the least rank is null.
        return F.aggregate(F.sequence(F.lit(1), n), let(single, start), step, lambda state: state["ids"])

    return let(literal, merges)


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, leftmost of least rank first, for a word of any length."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    current: list[int | None] = [None] * n
    heap: list[tuple[int, int]] = []

    def look(at: int) -> None:
        current[at] = None
        if after[at] < n:
            current[at] = ranks.get(word[at : ends[after[at]]])
            if current[at] is not None:
                heapq.heappush(heap, (current[at], at))

    for at in range(n):
        look(at)
    while heap:
        rank, at = heapq.heappop(heap)
        if current[at] != rank:
            continue
        gone = after[at]
        ends[at], after[at], current[gone] = ends[gone], after[gone], None
        if after[at] < n:
            before[after[at]] = at
        look(at)
        if before[at] >= 0:
            look(before[at])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = after[at]
    return out


def _assembled(kind: pa.DataType):
    def assembled(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        places = answers["place"].to_numpy()
        of = answers["ids"].combine_chunks() if answers.num_rows else pa.array([], pa.list_(pa.int32()))
        values, offsets = of.flatten().to_numpy(), of.offsets.to_numpy().astype(np.int64)
        if values.dtype == np.int16:
            values = values.astype(np.int32) + _SHORT
        offsets = offsets - offsets[0]
        size = int(places.max()) + 1 if len(places) else 0
        start, length = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        start[places], length[places] = offsets[:-1], np.diff(offsets)
        out = []
        for ids, counts, codes in zip(texts["docs"], texts["counts"], texts["codes"]):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            n = int(counts.sum())
            numbers = _numbers(codes.as_py(), n)
            if n and (numbers.max() >= size or length[numbers].min() < 0):
                raise ValueError("the texts of a chunk changed between two readings")
            long = length[numbers]
            upto = np.cumsum(long)
            at = np.arange(upto[-1] if n else 0) + np.repeat(start[numbers] - (upto - long), long)
            ends = np.r_[0, upto][np.cumsum(counts)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values[at], pa.int32()))
            out.append(pa.table({"doc_id": ids.values.cast(kind), "ids": lists}))
        if not out:
            return pa.table({"doc_id": pa.array([], kind), "ids": pa.array([], pa.list_(pa.int32()))})
        return pa.concat_tables(out)

    return assembled


def encoded(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", fold_bytes: int = FOLD_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, ids array<int>), one row per document, by the rank file at ``path``; no special tokens."""
    from pyspark.sql.pandas.types import to_arrow_type

    ranks, packed = read_ranks(path), _packed_classes()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    field = texts.schema["doc_id"]
    words = texts.mapInArrow(_words_of(packed, ranks, fold_bytes, chunk_bytes), "chunk long, place int, word binary, own array<int>")
    # One row of each word folds it, and the others take over its ids as they stream by.
    same = Window.partitionBy("word").orderBy("chunk", "place")
    first = words.withColumn("_first", F.row_number().over(same) == 1)
    ids = F.coalesce("own", folded(F.col("word"), ranks))
    if max(ranks.values()) < 2 * _SHORT:
        # Two bytes for an id on the way back.
        ids = F.transform(ids, lambda i: (i - _SHORT).cast("smallint"))
    made = first.withColumn("made", F.when(F.col("_first"), ids))
    so_far = same.rowsBetween(Window.unboundedPreceding, 0)
    answers = made.select("chunk", "place", F.first("made", ignorenulls=True).over(so_far).alias("ids"))
    coded = StructType([
        *StructType.fromDDL("chunk long"), StructField("docs", ArrayType(field.dataType)), *StructType.fromDDL("counts binary, codes binary"),
    ])
    rows = texts.mapInArrow(_texts_of(packed, chunk_bytes), coded)
    schema = StructType([StructField("doc_id", field.dataType), *StructType.fromDDL("ids array<int>")])
    kind = to_arrow_type(field.dataType)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_assembled(kind), schema)


class Pieces:
    """Byte strings by id, gathered for many ids at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        known = sorted(ranks.items(), key=lambda x: x[1])
        self.size = known[-1][1] + 1
        self.lengths, self.starts = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64)
        at = 0
        for piece, rank in known:
            self.lengths[rank], self.starts[rank] = len(piece), at
            at += len(piece)
        self.data = np.frombuffer(b"".join(p for p, _ in known), np.uint8)

    def known(self, ids: np.ndarray) -> np.ndarray:
        inside = (ids >= 0) & (ids < self.size)
        return inside & (self.lengths[np.where(inside, ids, 0)] >= 0)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in order, number of bytes up to the end of each)."""
        lengths = self.lengths[ids]
        upto = np.cumsum(lengths)
        at = np.arange(upto[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - (upto - lengths), lengths)
        return self.data[at], upto


def _decoded_rows(ids: pa.Array, pieces: Pieces) -> Iterator[tuple[int, np.ndarray | None, bytes | None]]:
    """(row, ids, bytes) of a column of id lists, a bounded number of ids at a time."""
    sizes = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ids):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + (1 << 20), side="right")))
        part = ids.slice(start, stop - start)
        values = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False)
        good = pieces.known(values)
        data, upto = pieces.joined(np.where(good, values, 0) if not good.all() else values)
        blob, upto, bad = data.tobytes(), np.r_[0, upto], np.r_[0, np.cumsum(~good)]
        for row in range(start, stop):
            a, b = (int(sizes[row - 1]) if row else 0) - base, int(sizes[row]) - base
            whole = ids[row].is_valid and bad[a] == bad[b]
            yield row, values[a:b] if ids[row].is_valid else None, blob[upto[a] : upto[b]] if whole else None
        start = stop


def decoded(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out`` (binary): the byte strings of ``ids`` one after the other."""
    ranks = read_ranks(path)
    schema = StructType([*rows.drop(out).schema.fields, *StructType.fromDDL(f"`{out}` binary")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks)
        for batch in batches:
            found = pa.array([b for _, _, b in _decoded_rows(batch[ids], pieces)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in schema.fields[:-1]), found], names=schema.names)

    return rows.drop(out).mapInArrow(decode, schema)


def digests(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of ids as little-endian 32-bit numbers, and of what they decode to."""
    ranks = read_ranks(path)
    schema = StructType([StructField("doc_id", rows.schema[doc_id].dataType), *StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string")])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            found = [
                (None if own is None else len(own), None if own is None else sha(own.astype("<u4").tobytes()), None if whole is None else sha(whole))
                for _, own, whole in _decoded_rows(batch[ids], pieces)
            ]
            n, of_ids, of_bytes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch[doc_id], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=schema.names
            )

    return rows.select(doc_id, ids).mapInArrow(digest, schema)
