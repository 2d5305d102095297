"""Suffix dedup: removes every byte that is covered by a string of ``LENGTH`` bytes (UTF-8) that also
starts earlier, in a document of a smaller id or earlier in the same one.

No suffix array is built and no ranks are doubled: anchors chosen by content are grouped by hash and compared
by fingerprints.

1. Anchors. Every start of ``LENGTH`` bytes is stood for by its anchor, the least hashed
   string of ``SEED`` bytes inside it: equal starts have equal anchors at equal distance. Anchors are
   dealt by seed and sorted; a seed that is unique leaves at once with all starts that it stands for.
2. Runs. Starts with one anchor form a run. Runs with equal seed are compared by all
   bytes from their first start to the end of their last: a run whose bytes also come earlier is removed
   as a whole, the first of a seed is original as a whole, and seeds of one such rank leave.
3. The few runs that are left, where matches begin or end, are cut into stretches of ``STRETCH`` starts,
   dealt by the bytes common to a stretch, and compared start by start at the full length.

In every step equal rows of a task are put together before they move (the first of them stands for all),
so the inside of a passage that a third of all documents share is a row per task. The stretches at its edges
differ from document to document and are not put together: all of one core meet in one task, as do different
runs of one seed. What moves are anchors, the text in
compressed blocks twice, and the stretches; the driver sees sizes only. Strings are compared by 64-bit
fingerprints together with the fingerprint of their seed.

Defined results: a null or empty text has no bytes; texts shorter than ``LENGTH`` are kept; rows without an
id are kept whole and take no part; of rows that repeat an id one stands for all and gives one result row
(the least text); an empty table gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from casemill.llm.words import Fingerprints, text_chunks
from casemill.session import durable

LENGTH = 100
SEED = 24
STRETCH = 16
#: Bytes of text in one block of documents, and the text whose anchors one bucket gets.
BLOCK_BYTES = 8 << 20
#: Bytes that are fingerprinted at a time, which bounds a task's memory, and that are put together.
CHUNK_BYTES = 1 << 18
GATHER_BYTES = 1 << 21
TEXT, RUNS, COVERED, OPEN, STRETCHES = range(5)
_ROWS = "kind int, place long, numbers binary, bytes binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed value; byte planes keep small numbers small."""
    table = np.stack([np.asarray(c, np.int64) for c in columns])
    return zstandard.compress(np.ascontiguousarray(table.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)), 1)


def unpack(blob: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(columns, 8, -1)
    return np.array(planes.transpose(0, 2, 1), order="C").view(np.int64).reshape(columns, -1)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "place", "numbers", "bytes"])


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((spread >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _covered_rows(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, blocks: int) -> list[tuple]:
    """Covered spans, joined where they touch, by block of documents."""
    order = np.lexsort((start, ids))
    ids, start, stop = merged_spans(ids[order], start[order], stop[order])
    block = block_of(ids, blocks)
    out = []
    for b in np.unique(block).tolist():
        own = block == b
        out.append((COVERED, b, pack(ids[own], start[own], stop[own]), None))
    return out


def merged_spans(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of (id, start, stop) rows in order of id and start."""
    if not len(ids):
        return ids, start, stop
    group = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])
    # Shift every document behind the one before it, so that one running maximum serves all.
    far = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + group * far)
    new = np.r_[True, start[1:] + group[1:] * far > reach[:-1]]
    cuts = np.flatnonzero(new)
    last = np.r_[cuts[1:], len(ids)] - 1
    return ids[cuts], start[cuts], reach[last] - group[last] * far


def _first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of rows in ``order``, true where any of the keys changes."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for key in keys:
            own = key[order]
            new[1:] |= own[1:] != own[:-1]
    return new


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys, by doubling the width that is covered."""
    covered, least = 1, keys
    while covered * 2 <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Runs of starts of ``length`` bytes that share an anchor, over concatenated documents.

    The anchor of a start is the least hashed string of ``seed`` bytes among those inside its ``length``
    bytes, the first of equals: it depends on these bytes only. A run is (row, first, last, at): document,
    first and last start and the anchor's position in the document, with the fingerprints ``seed`` of the
    anchor and ``span`` of all bytes from the first start to the end of the last.
    """
    starts = np.r_[0, ends[:-1]]
    valid_stop = np.maximum(ends - length + 1, starts)
    counts = valid_stop - starts
    if not counts.sum():
        return {c: np.zeros(0, np.int64) for c in ("row", "first", "last", "at", "seed", "span")}
    prints = Fingerprints(data)
    position = np.arange(len(data) - seed + 1)
    hashes = prints.of(position, position + seed)
    bits = np.uint64(int(len(data)).bit_length())
    keys = hashes >> bits << bits | position.astype(np.uint64)
    least = _window_least(keys, length - seed + 1)
    row = np.repeat(np.arange(len(ends)), counts)
    p = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at = (least[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    lasts = np.r_[cuts[1:], len(at)] - 1
    first, last, at, row = p[cuts], p[lasts], at[cuts], row[cuts]
    shape = ((last - first) << 32 | (at - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    span = prints.of(first, last + length) ^ shape
    return {
        "row": row, "first": first - starts[row], "last": last - starts[row], "at": at - starts[row],
        "seed": hashes[at].astype(np.int64), "span": span.astype(np.int64),
    }


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, offset, bytes): a text longer than a chunk comes in parts that overlap by length - 1."""
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), CHUNK_BYTES):
            yield row, offset, text[offset : offset + CHUNK_BYTES + length - 1] if len(text) > CHUNK_BYTES else text
            if len(text) <= CHUNK_BYTES:
                break


def _find_runs(length: int, seed: int, buckets: int, blocks: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, all_ids = batch["text"], batch["doc_id"].to_numpy()
            for start, stop in text_chunks(texts, GATHER_BYTES):
                own = [t.encode() for t in pc.fill_null(texts.slice(start, stop - start), "").to_pylist()]
                found: list[dict[str, np.ndarray]] = []
                group: list[tuple[int, int, bytes]] = []
                held = 0

                def flush(group=group, found=found) -> None:
                    ends = np.cumsum([len(b) for _, _, b in group])
                    part = anchored_runs(np.frombuffer(b"".join(b for _, _, b in group), np.uint8), ends, length, seed)
                    offset = np.array([o for _, o, _ in group])[part["row"]]
                    row = np.array([r for r, _, _ in group])[part["row"]]
                    found.append(part | {"row": row} | {c: part[c] + offset for c in ("first", "last", "at")})
                    group.clear()

                for piece in _segments(own, length):
                    group.append(piece)
                    held += len(piece[2])
                    if held >= CHUNK_BYTES:
                        flush()
                        held = 0
                if group:
                    flush()
                one = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
                ids = all_ids[start:stop][one["row"]]
                order = np.lexsort((one["first"], ids, one["span"], one["seed"]))
                lead = _first_of(order, one["seed"], one["span"])
                rest = order[~lead]
                out = _covered_rows(ids[rest], one["first"][rest], one["last"][rest] + length, blocks)
                order = order[lead]
                bucket = (one["seed"][order].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(bucket).tolist():
                    x = order[bucket == b]
                    first = one["first"][x]
                    out.append((RUNS, b, pack(np.diff(one["seed"][x], prepend=0), one["span"][x], ids[x], first,
                                              one["last"][x] - first, one["at"][x] - first), None))
                # Covered spans travel along with the anchors.
                yield _table([(k, p % buckets if k == RUNS else p, n, b) for k, p, n, b in out])

    return runs


def _rank_runs(length: int, blocks: int):
    """One bucket of anchors: what is covered, and the runs that need a closer look."""

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        kinds, places, blobs = (table[c].to_pylist() for c in ("kind", "place", "numbers"))
        out = [(k, p, b, None) for k, p, b in zip(kinds, places, blobs) if k == COVERED]
        parts = [unpack(b, 6) for k, b in zip(kinds, blobs) if k == RUNS]
        if parts:
            for part in parts:
                part[0] = np.cumsum(part[0])
            seed, span, ids, first, more, at = np.concatenate(parts, axis=1)
            order = np.argsort(seed, kind="stable")
            twin = np.r_[False, seed[order][1:] == seed[order][:-1]]
            order = order[twin | np.r_[twin[1:], False]]
            seed, span, ids, first, more, at = (x[order] for x in (seed, span, ids, first, more, at))
            order = np.lexsort((first, ids, span, seed))
            lead = _first_of(order, seed, span)
            rest = order[~lead]
            out += _covered_rows(ids[rest], first[rest], first[rest] + more[rest] + length, blocks)
            order = order[lead]
            new_seed = _first_of(order, seed)
            spans = np.diff(np.r_[np.flatnonzero(new_seed), len(order)])
            order = order[np.repeat(spans > 1, spans)]
            block = block_of(ids[order], blocks)
            for b in np.unique(block).tolist():
                x = order[block == b]
                x = x[np.lexsort((first[x], ids[x]))]
                out.append((OPEN, b, pack(ids[x], first[x], more[x], at[x]), None))
        return pa.Table.from_batches([_table(out)])

    return rank


def _texts(blocks: int):
    """Whole texts by block of documents, compressed."""

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_chunks(batch["text"], GATHER_BYTES):
                ids = batch["doc_id"].slice(start, stop - start).to_numpy()
                own = [t.encode() for t in pc.fill_null(batch["text"].slice(start, stop - start), "").to_pylist()]
                block, out = block_of(ids, blocks), []
                for b in np.unique(block).tolist():
                    rows = np.flatnonzero(block == b)
                    whole = b"".join(own[r] for r in rows.tolist())
                    out.append((TEXT, b, pack(ids[rows], [len(own[r]) for r in rows.tolist()]), zstandard.compress(whole, 3)))
                yield _table(out)

    return texts_of


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, start of each document and the total, all bytes) of one block."""
    ids, sizes, texts = [], [], []
    for numbers, whole in zip(table["numbers"].to_pylist(), table["bytes"].to_pylist()):
        own_ids, own_sizes = unpack(numbers, 2)
        ids.append(own_ids)
        sizes.append(own_sizes)
        texts.append(zstandard.decompress(whole))
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(ids, kind="stable")
    data = np.frombuffer(b"".join(texts), np.uint8)
    return ids[order], np.stack([starts[order], sizes[order]]), data


def _numbers(table: pa.Table, columns: int) -> np.ndarray:
    parts = [unpack(b, columns) for b in table["numbers"].to_pylist()]
    return np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), np.int64)


def _cut_stretches(length: int, stretch: int, buckets: int, blocks: int):
    """Stretches of the open runs of one block, with their bytes."""

    def cut(key: tuple, docs: pa.Table, open_runs: pa.Table) -> pa.Table:
        if not len(open_runs) or not len(docs):
            return pa.Table.from_batches([_table([])])
        doc_ids, where, data = _documents(docs)
        ids, first, more, at = _numbers(open_runs, 4)
        base = where[0][np.searchsorted(doc_ids, ids)]
        # Stretches are aligned to the distance from the anchor, so equal starts fall into equal ones.
        lowest, highest = at // stretch, (at - more) // stretch
        n = lowest - highest + 1
        run = np.repeat(np.arange(len(ids)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        level = lowest[run] - step
        start = first[run] + np.maximum(at[run] - (level * stretch + stretch - 1), 0)
        stop = first[run] + np.minimum(at[run] - level * stretch, more[run])
        where_start, where_stop = base[run] + start, base[run] + stop
        # What all starts of a whole stretch have in common, also where this one is cut short by its run.
        common = base[run] + first[run] + at[run] - level * stretch
        core, whole = _prints_in_parts(data, where_start, where_stop, common, length, stretch)
        owner = ids[run]
        order = np.lexsort((start, owner, whole, core))
        lead = _first_of(order, core, whole)
        rest = order[~lead]
        out = _covered_rows(owner[rest], start[rest], stop[rest] + length, blocks)
        order = order[lead]
        bucket = (core[order].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            x = order[bucket == b]
            pieces = b"".join(data[s : e + length].tobytes() for s, e in zip(where_start[x].tolist(), where_stop[x].tolist()))
            out.append((STRETCHES, b, pack(owner[x], start[x], stop[x] - start[x]), zstandard.compress(pieces, 3)))
        return pa.Table.from_batches([_table(out)])

    return cut


def _prints_in_parts(
    data: np.ndarray, start: np.ndarray, stop: np.ndarray, common: np.ndarray, length: int, stretch: int
) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the bytes common to a stretch and of all its bytes; the data is taken part by part."""
    core, whole = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    order = np.argsort(start, kind="stable")
    at = 0
    while at < len(order):
        low = int(start[order[at]])
        upto = int(np.searchsorted(start[order], low + CHUNK_BYTES, side="right"))
        own = order[at:upto]
        high = int(stop[own].max()) + length
        prints = Fingerprints(data[low:high])
        core[own] = prints.of(common[own] - low, common[own] + length - stretch + 1 - low).astype(np.int64)
        shape = (stop[own] - start[own]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        whole[own] = (prints.of(start[own] - low, stop[own] + length - low) ^ shape).astype(np.int64)
        at = upto
    return core, whole


def _rank_starts(length: int, blocks: int):
    """One bucket of stretches: every start whose bytes also come earlier."""

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        kinds, places = table["kind"].to_pylist(), table["place"].to_pylist()
        numbers, pieces = table["numbers"].to_pylist(), table["bytes"].to_pylist()
        out = [(k, p, n, None) for k, p, n in zip(kinds, places, numbers) if k == COVERED]
        found = []
        for k, n, whole in zip(kinds, numbers, pieces):
            if k == STRETCHES:
                ids, first, more = unpack(n, 3)
                sizes = more + length
                base = np.cumsum(sizes) - sizes
                counts = more + 1
                step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(base, counts) + step
                prints = Fingerprints(np.frombuffer(zstandard.decompress(whole), np.uint8)).of(at, at + length)
                found.append((prints, np.repeat(ids, counts), np.repeat(first, counts) + step))
        if found:
            prints, ids, first = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(prints, kind="stable")
            twin = np.r_[False, prints[order][1:] == prints[order][:-1]]
            order = order[twin | np.r_[twin[1:], False]]
            prints, ids, first = prints[order], ids[order], first[order]
            order = np.lexsort((first, ids, prints))
            rest = order[~_first_of(order, prints)]
            out += _covered_rows(ids[rest], first[rest], first[rest] + length, blocks)
        return pa.Table.from_batches([_table(out)])

    return rank


def _remove(with_text: bool):
    """The documents of one block without their covered bytes."""

    def remove(key: tuple, docs: pa.Table, covered: pa.Table) -> pa.Table:
        ids, (starts, sizes), data = _documents(docs)
        own = _numbers(covered, 3)
        order = np.lexsort((own[1], own[0]))
        span_ids, span_start, span_stop = merged_spans(*(x[order] for x in own))
        low, high = np.searchsorted(span_ids, ids, "left"), np.searchsorted(span_ids, ids, "right")
        removed, spans, digests, kept_texts = [], [], [], []
        for doc, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            text = data[starts[doc] : starts[doc] + sizes[doc]].tobytes()
            kept, at = [], 0
            for s, e in zip(span_start[a:b].tolist(), span_stop[a:b].tolist()):
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            removed.append(len(text) - len(rest))
            spans.append(list(zip(span_start[a:b].tolist(), span_stop[a:b].tolist())))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest.decode("utf-8", "ignore") if with_text else None)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array([[{"start": s, "stop": e} for s, e in x] for x in spans], kinds),
            "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept_texts, pa.string()),
        })

    return remove


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, stretch: int = STRETCH,
    block_bytes: int = BLOCK_BYTES, with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept_text), one row per document.

    ``spans`` are the maximal removed runs of bytes (start, stop), the digest is of the bytes that stay.
    ``kept_text`` is filled on request; bytes of a character that was cut are dropped from it.
    """
    if not seed <= length - stretch:
        raise ValueError("seed must not be longer than length - stretch")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    facts = known.agg(F.sum(F.octet_length("text")).alias("size")).first()
    if known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        known = durable(known.groupBy("doc_id").agg(F.min("text").alias("text")))
    blocks = max(1, math.ceil((facts["size"] or 0) / block_bytes))
    runs = known.mapInArrow(_find_runs(length, seed, blocks, blocks), _ROWS)
    ranked = durable(runs.groupBy("place").applyInArrow(_rank_runs(length, blocks), _ROWS))
    whole = known.mapInArrow(_texts(blocks), _ROWS)
    open_runs = ranked.where(F.col("kind") == OPEN)
    stretches = whole.groupBy("place").cogroup(open_runs.groupBy("place")).applyInArrow(
        _cut_stretches(length, stretch, blocks, blocks), _ROWS
    )
    closer = durable(stretches.groupBy("place").applyInArrow(_rank_starts(length, blocks), _ROWS))
    covered = ranked.where(F.col("kind") == COVERED).union(closer)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string, kept_text string"
    out = whole.groupBy("place").cogroup(covered.groupBy("place")).applyInArrow(_remove(with_text), schema)
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    unknown = rows.where(F.col("doc_id").isNull()).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        empty.alias("spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
        (F.coalesce("text", F.lit("")) if with_text else F.lit(None).cast("string")).alias("kept_text"),
    )
    return out.unionByName(unknown)
