"""Ranked lexical search the other way round: documents stream through an index of the searched items.

1. Items are cut into distinct terms; blocks of items of at most ``block_bytes`` of terms are formed from their
   running sum (one item is never split). The inverted index of a block, terms to items, is broadcast: its
   size is bounded by that parameter, or by the terms of its one item.
2. Every document is read once per block and becomes its number of terms and its counts of the terms in the index.
   The statistics of the corpus are summed from these, exactly and over all documents.
3. Documents stream through the index: a term's weight goes to all items that hold it, and each item keeps a
   bounded heap of its ``k`` best documents, here sorted arrays for all items of the block at once. A document
   that cannot enter a heap is left behind by one comparison.
4. The heaps of all tasks are merged, first in parts, then per item.

Scores are whole numbers of 64 bits: terms are the maximal runs of ASCII letters, digits and all other code
points from 128 on; only A-Z are lower-cased. With N documents that have a term, L terms in all and document
frequencies df, a term weighs w = floor(scale * ln((2N + 2) / (2 df + 1))); a document of n terms has
m = 10 + 90 n N div L and scores the sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's terms.

Defined results: a null text has no terms and is found by nothing, as an item without terms finds nothing;
documents of score 0 are not returned; equal scores go by ascending document id, null ids last; rows that
repeat an id are documents, or items, of their own; an empty table gives no rows; other columns are ignored.
Document ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from casemill.llm.running import shuffle_key, with_running_sum
from casemill.llm.words import text_chunks
from casemill.session import durable

K = 10
BLOCK_BYTES = 16 << 20
MERGE_PARTS = 32
_CELLS = 1 << 22
_BYTES = np.arange(256)
_IN_TERM = (_BYTES >= 0x80) | np.isin(_BYTES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms in order as bytes, number of terms up to the end of each text)."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    inside = _IN_TERM[data]
    starts = inside & np.r_[True, ~inside[:-1]]
    opens = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
    starts[opens] |= inside[opens]
    kept = _LOWER[data[inside]]
    cuts = np.r_[np.flatnonzero(starts[inside]), len(kept)].astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    return terms, np.searchsorted(np.flatnonzero(starts), ends)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each item, with a space between."""
    for batch in batches:
        for at in range(batch.num_rows):
            found = pc.unique(terms_of(batch["text"].slice(at, 1))[0]).to_pylist()
            joined = b" ".join(found)
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"].slice(at, 1), batch["item"].slice(at, 1), pa.array([joined], pa.binary()), pa.array([len(joined) + 1], pa.int64())],
                names=["item_id", "item", "terms", "size"],
            )


class Index:
    """Items of a block by term."""

    def __init__(self, terms: list[bytes]) -> None:
        sets = [t.split(b" ") if t else [] for t in terms]
        self.vocabulary = sorted(set().union(*sets))
        place = {t: i for i, t in enumerate(self.vocabulary)}
        flat = np.array([place[t] for s in sets for t in s], np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.items = owner[order]
        self.starts = np.searchsorted(flat[order], np.arange(len(self.vocabulary) + 1))
        self.n_items = len(sets)


def _counted(shared):
    """Documents as number of terms, and numbers and counts of the terms that the index holds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value.vocabulary, pa.binary())
        size = max(1, len(known))
        for batch in batches:
            for start, stop in text_chunks(batch["text"]):
                terms, ends = terms_of(batch["text"].slice(start, stop - start))
                found = pc.index_in(terms, known)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(stop - start), np.diff(ends, prepend=0))[hit]
                keys, counts = np.unique(owner * size + found.drop_null().to_numpy(), return_counts=True)
                cuts = np.searchsorted(keys, np.arange(stop - start + 1) * size)
                numbers, counts = (keys % size).astype(np.int32), counts.astype(np.int32)
                blobs = [pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(x)]) for x in (numbers, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, stop - start), pa.array(np.diff(ends, prepend=0), pa.int64()), *blobs], names=["doc_id", "n", "terms", "counts"]
                )

    return counted


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _frequencies(size: int):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch["terms"]), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "df"])

    return frequencies


class Heaps:
    """The ``k`` best (score, document) of each item; a place without a document has score 0."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.scores = np.zeros((n_items, k), np.int64)
        self.keys = np.zeros((n_items, k), np.uint64)
        self.known = np.zeros((n_items, k), bool)

    def offer(self, scores: np.ndarray, keys: np.ndarray, known: np.ndarray) -> None:
        """``scores`` of documents (rows) for items (columns)."""
        worst, worst_key = self.scores[:, -1], self.keys[:, -1]
        rows, items = np.nonzero((scores > worst) | ((scores == worst) & (keys[:, None] < worst_key)))
        if not len(rows):
            return
        touched = np.unique(items)
        item = np.r_[items, np.repeat(touched, self.k)]
        score = np.r_[scores[rows, items], self.scores[touched].ravel()]
        key = np.r_[keys[rows], self.keys[touched].ravel()]
        is_known = np.r_[known[rows], self.known[touched].ravel()]
        order = np.lexsort((~is_known, key, -score, item))
        firsts = np.searchsorted(item[order], touched)
        best = order[firsts[:, None] + np.arange(self.k)]
        self.scores[touched], self.keys[touched], self.known[touched] = score[best], key[best], is_known[best]


def _ranked(shared, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(index.n_items, k)
        degree = np.diff(index.starts)
        # The first documents fill the heaps, most later ones are then left behind at once.
        room, most = 64, max(1, _CELLS // max(1, index.n_items))
        for batch in batches:
            sizes = pc.binary_length(batch["terms"]).to_numpy() // 4
            terms, counts = _values(batch["terms"]), _values(batch["counts"]).astype(np.int64)
            ends = np.cumsum(sizes)
            n = batch["n"].to_numpy()
            known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch["doc_id"].cast(pa.int64()), (1 << 63) - 1).to_numpy()
            keys = ids.view(np.uint64) ^ np.uint64(1 << 63)
            upto = np.r_[0, np.cumsum(degree[terms])]
            of_doc = upto[np.r_[0, ends]]
            start = 0
            while start < len(n):
                # Bounded cells of documents and items, and bounded additions; one document at least.
                stop = min(start + min(room, most), int(np.searchsorted(of_doc, of_doc[start] + _CELLS, side="right")) - 1)
                stop = max(start + 1, min(stop, len(n)))
                own = slice(int(ends[start - 1]) if start else 0, int(ends[stop - 1]))
                term, tf = terms[own], counts[own]
                doc = np.repeat(np.arange(stop - start), sizes[start:stop])
                m = 10 + 90 * n[start:stop] * n_docs // max(1, n_terms)
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                often = degree[term]
                at = np.arange(often.sum()) + np.repeat(index.starts[term] - (np.cumsum(often) - often), often)
                cells = np.repeat(doc * index.n_items, often) + index.items[at]
                scores = np.zeros((stop - start) * index.n_items, np.int64)
                np.add.at(scores, cells, np.repeat(value, often))
                heaps.offer(scores.reshape(stop - start, -1), keys[start:stop], known[start:stop])
                start, room = stop, room * 4
        items, places = np.nonzero(heaps.scores > 0)
        known = heaps.known[items, places]
        ids = (heaps.keys[items, places] ^ np.uint64(1 << 63)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(heaps.scores[items, places], pa.int64()), pa.array(ids, pa.int64(), mask=~known)], names=["place", "score", "doc_id"]
        )

    return ranked


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first rows of each item, ranked; parts of the heaps are merged before they meet."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    parts = found.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order)))
    best = parts.where(F.col("_rank") <= k).drop("_part", "_rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def searched(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    scale: int = 1000, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score for each item."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = items.select(
        F.col(item_id).alias("item_id"), F.monotonically_increasing_id().alias("item"), F.col(item_text).cast("string").alias("text")
    )
    kind = named.schema["item_id"]
    cut = StructType([StructField("item_id", kind.dataType), *StructType.fromDDL("item long, terms binary, size long")])
    terms = durable(named.mapInArrow(_item_terms, cut))
    total = terms.agg(F.sum("size")).first()[0] or 0
    if total > block_bytes:
        summed = with_running_sum(terms.withColumn("_one", F.lit(1)).withColumn("_key", shuffle_key(F.col("item"))), "_one", "_key", "size", "_upto", ["item"])
        placed = durable(summed.withColumn("block", F.expr(f"(_upto - size) div {block_bytes}")).select("item_id", "item", "terms", "block"))
    else:
        placed = terms.withColumn("block", F.lit(0))
    context = docs.sparkSession.sparkContext
    found = None
    for block in range(-(-total // block_bytes)):
        own = placed.where(F.col("block") == block)
        # At most ``block_bytes`` of terms, or one item's.
        rows = own.select("item", "terms").collect()
        if not rows:
            continue
        index = Index([bytes(r["terms"]) for r in rows])
        shared = context.broadcast(index)
        postings = durable(texts.mapInArrow(_counted(shared), "doc_id long, n long, terms binary, counts binary"))
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        size = len(index.vocabulary)
        df = np.zeros(size, np.int64)
        # One row per term of the index.
        for r in postings.select("terms").mapInArrow(_frequencies(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(scale * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        heaps = postings.mapInArrow(_ranked(shared, weights, n_docs, n_terms, k), "place long, score long, doc_id long")
        names = docs.sparkSession.createDataFrame([(at, r["item"]) for at, r in enumerate(rows)], "place long, item long")
        part = heaps.join(F.broadcast(names), "place").select("item", "score", "doc_id")
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, score long, doc_id long")
    return _merged(found, k).join(terms.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
