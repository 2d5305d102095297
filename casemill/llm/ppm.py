"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER``, pretrained on the training rows. A byte is predicted
in its longest known context by (2c - 1) / 2t, c being its count and t the count of all symbols there. A
byte that was not seen there escapes, with u / 2t for u distinct symbols, to the next shorter context, in
which the symbols of the longer one are excluded, and in the end to the uniform choice among the bytes
never seen. The longest contexts count occurrences; a shorter one counts each symbol once for every longer
context that it was new in, as an update that stops at the longest known context does. A text starts in a
context of padding bytes and ends with an end symbol; both are values that UTF-8 does not use.

The symbols of a context all occur in every shorter one, so what is excluded depends on the next longer
context alone, and the probability of a byte is a function of the last ``ORDER + 1`` bytes. So the corpus
is reduced to grams of that length:

1. Documents are dealt to blocks of about ``block_bytes``. Each block counts its distinct grams and words.
2. Grams are dealt by the two bytes before the predicted one: all contexts of two bytes and more of a gram
   are then in one place, shorter ones follow from the distinct
   three-byte strings, a table of fixed size that every task gets. Each
   bucket adds up the blocks' counts and returns to each block the log probability of its grams; buckets
   of words return the corpus counts of its words.
3. Each block scores its documents with the answers to its own grams and words.

What moves is the text, twice, and the distinct grams and words of each block; no table of the corpus is
collected or broadcast. A common gram is one entry per block, so nothing is hot.

Defined results: a null text is empty and scores its end symbol; null or repeated ids are scored row by
row; without training rows every byte has 1/256; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.words import text_chunks, word_lists
from casemill.session import durable

ORDER = 5
START, END = 0xFE, 0xFF
BLOCK_BYTES = 16 << 20
BUCKETS = 64
GRAMS, WORDS, SHORT = 0, 1, 2
_FACTS = "kind int, bucket int, block long, keys binary, counts binary"


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts in order, the number of grams up to the end of each): ORDER + 1 bytes in a number."""
    sizes = np.array([len(t) + 1 for t in texts])
    pad = bytes([START]) * ORDER
    raw = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    grams = np.zeros(max(len(raw) - ORDER, 0), np.int64)
    for back in range(ORDER + 1):
        grams = grams << 8 | raw[back : len(raw) - ORDER + back]
    text_at = np.repeat(np.arange(len(sizes)), sizes)
    return grams[np.arange(sizes.sum()) + text_at * ORDER], np.cumsum(sizes)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    pair = (grams >> 8 & 0xFFFF).astype(np.uint64)
    return ((pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _blob(values: np.ndarray) -> bytes:
    return _squeezed(np.ascontiguousarray(values).tobytes())


def _array(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_whole(blob), kind)


def _packed_grams(grams: np.ndarray) -> bytes:
    return _blob(np.diff(grams, prepend=0))


def _unpacked_grams(blob: bytes) -> np.ndarray:
    return np.cumsum(_array(blob, np.int64))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their added counts."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64)
    found, inverse = np.unique(keys, return_inverse=True)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0)
    return found, np.bincount(inverse, counts, len(found)).astype(np.int64)


def _block_facts(buckets: int):
    """The distinct grams and words of a block with their training counts, one row per bucket."""

    def facts(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        out: list[tuple] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: dict[str, int] = {}
        triples, ends_trained = [np.zeros(0, np.int64)], 0
        for batch in table.to_batches():
            for start, stop in text_chunks(batch["text"]):
                texts = pc.fill_null(batch["text"].slice(start, stop - start), "")
                trains = batch["trains"].slice(start, stop - start).to_numpy(zero_copy_only=False)
                ends_trained += int(trains.sum())
                for trained in (True, False):
                    own = texts.filter(pa.array(trains == trained))
                    if not len(own):
                        continue
                    found, counts = np.unique(grams_of([t.encode() for t in own.to_pylist()])[0], return_counts=True)
                    if trained:
                        triples = [np.unique(np.concatenate([*triples, found & 0xFFFFFF]))]
                    grams.append((found, counts * trained))
                    for pair in word_lists(pc.ascii_lower(own))[0].value_counts().to_pylist():
                        words[pair["values"]] = words.get(pair["values"], 0) + pair["counts"] * trained
                if len(grams) > 8:
                    grams = [_merged(grams)]
        codes, counts = _merged(grams)
        dealt = bucket_of(codes, buckets)
        for bucket in np.unique(dealt).tolist():
            own = dealt == bucket
            out.append((GRAMS, bucket, block, _packed_grams(codes[own]), _blob(counts[own])))
        by_bucket: dict[int, list[str]] = {}
        for word in words:
            by_bucket.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
        for bucket, own in by_bucket.items():
            counts = np.array([words[w] for w in own], np.int64)
            out.append((WORDS, bucket, block, _squeezed(" ".join(own).encode()), _blob(counts)))
        out.append((SHORT, block % 16, block, ends_trained.to_bytes(8, "little"), _packed_grams(triples[0])))
        return _facts_table(out)

    return facts


def _facts_table(rows: list[tuple]) -> pa.Table:
    kinds = [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns)})


def _short_sum(key: tuple, table: pa.Table) -> pa.Table:
    ends = sum(int.from_bytes(k.as_py(), "little") for k in table["keys"])
    triples = np.unique(np.concatenate([_unpacked_grams(c.as_py()) for c in table["counts"]]))
    return _facts_table([(SHORT, key[0].as_py(), 0, ends.to_bytes(8, "little"), _packed_grams(triples))])


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def log_probabilities(grams: np.ndarray, counts: np.ndarray, short: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 P(last byte | bytes before) of distinct ``grams``, with their training counts.

    ``grams`` must hold every trained gram that shares two context bytes with one of them; ``short`` are the
    numbers of distinct bytes seen before each (byte, byte).
    """
    trained = counts > 0
    levels = [(order, grams[trained], counts[trained].astype(float))]
    for length in range(order - 1, 1, -1):
        keys, own = np.unique(levels[-1][1] & (1 << 8 * (length + 1)) - 1, return_counts=True)
        levels.append((length, keys, own.astype(float)))
    for length, own in ((1, short), (0, (short.reshape(256, 256) > 0).sum(0))):
        keys = np.flatnonzero(own)
        levels.append((length, keys, own[keys].astype(float)))
    contexts = []
    for place, (length, keys, own) in enumerate(levels):
        context, inverse = np.unique(keys >> 8, return_inverse=True)
        total, distinct = np.bincount(inverse, own, len(context)), np.bincount(inverse, minlength=len(context))
        excluded = np.zeros(len(context))
        if length:
            _, shorter, theirs = levels[place + 1]
            at, _ = _find(shorter, keys & (1 << 8 * length) - 1)
            excluded = np.bincount(inverse, theirs[at] if len(theirs) else None, len(context))
        contexts.append((context, total, distinct, excluded))
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    gone_total, gone_distinct = np.zeros(len(grams)), np.zeros(len(grams))
    for (length, keys, own), (context, total, distinct, excluded) in zip(levels, contexts):
        wanted = grams & (1 << 8 * (length + 1)) - 1
        at, hit = _find(keys, wanted)
        place, known = _find(context, wanted >> 8)
        if not len(keys):
            continue
        left, symbols = total[place] - gone_total, distinct[place] - gone_distinct
        found, escapes = open_ & hit, open_ & known & ~hit
        out[found] += np.log10((2 * own[at[found]] - 1) / (2 * left[found]))
        costs = escapes & (symbols > 0)
        out[costs] += np.log10(symbols[costs] / (2 * left[costs]))
        open_ &= ~hit
        gone_total = np.where(escapes, excluded[place], 0.0)
        gone_distinct = np.where(escapes, distinct[place], 0.0)
    out[open_] -= np.log10(256 - len(levels[-1][1]))
    return out


def _answers(short: np.ndarray):
    """For one bucket: to each block the log probabilities of its grams, or the corpus counts of its words."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        kind, bucket = (k.as_py() for k in key)
        blocks, keys, counts = (table[c].to_pylist() for c in ("block", "keys", "counts"))
        out = []
        if kind == GRAMS:
            own = [_unpacked_grams(k) for k in keys]
            found, total = _merged([(g, _array(c, np.int64)) for g, c in zip(own, counts)])
            values = log_probabilities(found, total, short)
            for block, blob, grams in zip(blocks, keys, own):
                out.append((kind, bucket, block, blob, _blob(values[np.searchsorted(found, grams)])))
        else:
            total: dict[str, int] = {}
            for blob, count in zip(keys, counts):
                for word, n in zip(_whole(blob).decode().split(" "), _array(count, np.int64).tolist()):
                    total[word] = total.get(word, 0) + n
            for block, blob in zip(blocks, keys):
                answers = np.array([total[w] for w in _whole(blob).decode().split(" ")], np.int64)
                out.append((kind, bucket, block, blob, _blob(answers)))
            # Block -1 tells the size of this bucket's vocabulary and its training words.
            known = [n for n in total.values() if n]
            out.append((kind, bucket, -1, b"", np.array([len(known), sum(known)], np.int64).tobytes()))
        return _facts_table(out)

    return answer


def _score(ends_trained: int, words_trained: int, vocabulary: int):
    tokens_trained = words_trained + ends_trained
    distinct = vocabulary + (ends_trained > 0)
    base = lambda count: np.log10((count + 1) / (tokens_trained + distinct + 1))

    def score(key: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        parts, words, counts = [], [], []
        for kind, keys, values in zip(facts["kind"].to_pylist(), facts["keys"].to_pylist(), facts["counts"].to_pylist()):
            if kind == GRAMS:
                parts.append((_unpacked_grams(keys), _array(values, float)))
            else:
                words += _whole(keys).decode().split(" ")
                counts.append(_array(values, np.int64))
        grams = np.concatenate([g for g, _ in parts])
        order = np.argsort(grams)
        # Looking grams up by hash is some three times faster here than a binary search.
        place, logs = pd.Index(grams[order]), np.concatenate([v for _, v in parts])[order]
        known_words, word_counts = pa.array(words, pa.string()), np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ids, rows = [], []
        for batch in docs.to_batches():
            for start, stop in text_chunks(batch["text"]):
                texts = pc.fill_null(batch["text"].slice(start, stop - start), "")
                own, ends = grams_of([t.encode() for t in texts.to_pylist()])
                text_at = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
                total = np.bincount(text_at, logs[place.get_indexer(own)], len(texts))
                of_text, word_ends = word_lists(pc.ascii_lower(texts))
                count = word_counts[pc.index_in(of_text, known_words).to_numpy()] if len(of_text) else np.zeros(0, np.int64)
                word_at = np.repeat(np.arange(len(texts)), np.diff(word_ends, prepend=0))
                ids.append(batch["doc_id"].slice(start, stop - start))
                rows.append((
                    np.diff(word_ends, prepend=0) + 1,
                    np.bincount(word_at[count > 0], minlength=len(texts)) + (ends_trained > 0),
                    np.bincount(word_at, base(count), len(texts)) + base(ends_trained),
                    total,
                    batch["trains"].slice(start, stop - start),
                ))
        return _scored(ids, rows)

    def _scored(ids: list, rows: list) -> pa.Table:
        chunks = []
        for own_ids, (n_tokens, n_known, base_score, total, trains) in zip(ids, rows):
            n = pa.array(np.full(len(own_ids), tokens_trained), pa.int64())
            chunks.append(pa.table({
                "doc_id": own_ids, "trained": trains, "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()), "train_tokens": n, "base_score": pa.array(base_score),
                "score": pa.array(total),
            }))
        return pa.concat_tables(chunks)

    return score


def scored(
    docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text",
    block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``trains`` says over ``docs`` which rows the model learns from. ``score`` is the log10 probability of the
    whole text; ``base_score`` is that of its words under add-one word frequencies.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    facts = durable(dealt.groupBy("block").applyInArrow(_block_facts(buckets), _FACTS))
    sums = facts.where(F.col("kind") == SHORT).groupBy("bucket").applyInArrow(_short_sum, _FACTS).collect()
    # At most 2**24 three-byte strings, whatever the corpus holds.
    triples = np.unique(np.concatenate([np.zeros(0, np.int64), *(_unpacked_grams(r["counts"]) for r in sums)]))
    short = np.bincount(triples & 0xFFFF, minlength=1 << 16)
    ends = sum(int.from_bytes(r["keys"], "little") for r in sums)
    answers = durable(facts.where(F.col("kind") != SHORT).groupBy("kind", "bucket").applyInArrow(_answers(short), _FACTS))
    # At most one row per bucket.
    totals = [np.frombuffer(r["counts"], np.int64) for r in answers.where(F.col("block") == -1).select("counts").collect()]
    vocabulary, words = (int(x) for x in sum(totals, np.zeros(2, np.int64)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.where(F.col("block") >= 0).groupBy("block")).applyInArrow(
        _score(ends, words, vocabulary), schema
    )
