"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text becomes the set of its hashed character n-grams (A-Z lower-cased, a space on both ends). From the
training rows come the log-count ratio of every hash bucket, the buckets that tell the classes apart and,
on those, a logistic regression over ratio-scaled presence features. Scoring reads each whole text once
with a weight table of fixed size.

Training reads at most ``rows_per_class`` labelled rows of each class, taken in hash order of the id: the
documented bound of the fit. Every document is scored.

Defined results: null and empty texts score like a text without known n-grams; a null label or a label
without document trains nothing; several labels of one document count by their maximum; without rows of
both classes every score is the share of the class that there is (0.5 without labels); ids may be null
or repeated, each row is scored by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.words import text_chunks

NGRAMS = (3, 4, 5, 6)
BUCKET_BITS = 20
FEATURES = 1 << 15
ROWS_PER_CLASS = 8192
_SLICES = 64
_CHUNK = 1 << 18


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram occurrence of every text; rows in order within each n."""
    padded = [f" {t} " for t in pc.fill_null(pc.ascii_lower(texts), "").to_pylist()]
    sizes = np.array([len(t) for t in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    rows, buckets = [], []
    mixed = codes.copy()
    for n in range(2, max(NGRAMS) + 1):
        mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in NGRAMS:
            fits = left[: len(mixed)] >= n
            spread = (mixed + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            rows.append(row[: len(mixed)][fits])
            buckets.append((spread >> np.uint64(64 - BUCKET_BITS))[fits].astype(np.int32))
    return np.concatenate(rows), np.concatenate(buckets)


def _distinct(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(rows.astype(np.int64) << BUCKET_BITS | buckets)
    return keys >> BUCKET_BITS, (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class per bucket, in slices."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        texts, labels = batch["text"], batch["label"].to_numpy()
        for start, stop in text_chunks(texts, _CHUNK):
            rows, buckets = _distinct(*grams(texts.slice(start, stop - start)))
            for label in (0, 1):
                counts[label] += np.bincount(buckets[labels[start:stop][rows] == label], minlength=counts.shape[1])
    if counts.any():
        parts = counts.reshape(2, _SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_SLICES), pa.int32()), pa.array([parts[:, s].tobytes() for s in range(_SLICES)], pa.binary())],
            names=["slice", "counts"],
        )


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py(), np.int64) for b in table["counts"])
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _chosen(feature_of: np.ndarray):
    """Of each training row, the label and the chosen features it holds."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch["text"], []
            for start, stop in text_chunks(texts, _CHUNK):
                rows, buckets = grams(texts.slice(start, stop - start))
                feature = feature_of[buckets]
                rows, feature = _distinct(rows[feature >= 0], feature[feature >= 0])
                out += np.split(feature, np.searchsorted(rows, np.arange(1, stop - start)))
            blobs = pa.array([f.astype(np.int32).tobytes() for f in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["label"], blobs], names=["label", "features"])

    return rows_of


def _fit(ratio: np.ndarray, rounds: int = 150, penalty: float = 1e-5):
    """Logistic regression by accelerated gradient steps on the bounded sample."""

    def fit(table: pa.Table) -> pa.Table:
        y = table["label"].to_numpy().astype(float)
        lists = [np.frombuffer(b.as_py(), np.int32) for b in table["features"]]
        order = sorted(range(len(lists)), key=lambda i: (y[i], lists[i].tobytes()))
        lists, y = [lists[i] for i in order], y[order]
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        parts = []
        for at in range(0, len(lists), 512):
            own = lists[at : at + 512]
            row = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
            index = np.concatenate(own)
            value = ratio[index]
            norm = np.sqrt(np.maximum(np.bincount(row, value * value, len(own)), 1e-12))
            parts.append((slice(at, at + len(own)), row, index, (value / norm[row]).astype(np.float32)))
        w, b = np.zeros(len(ratio)), 0.0
        v, c = w.copy(), b
        for step in range(1, rounds + 1):
            slope, shift = penalty * v, 0.0
            for rows, row, index, value in parts:
                margin = np.bincount(row, value * v[index], rows.stop - rows.start) + c
                error = (1 / (1 + np.exp(-margin)) - y[rows]) * share[rows]
                slope += np.bincount(index, value * error[row], len(ratio))
                shift += error.sum()
            w_next, b_next = v - 3.5 * slope, c - 3.5 * shift
            momentum = (step - 1) / (step + 2)
            v, c = w_next + momentum * (w_next - w), b_next + momentum * (b_next - b)
            w, b = w_next, b_next
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "bias": [b]})

    return fit


def _scorer(feature_of: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = batch["text"], []
            for start, stop in text_chunks(texts, _CHUNK):
                n = stop - start
                rows, buckets = grams(texts.slice(start, n))
                feature = feature_of[buckets]
                rows, feature = _distinct(rows[feature >= 0], feature[feature >= 0])
                size = ratio[feature]
                norm = np.sqrt(np.maximum(np.bincount(rows, size * size, n), 1e-12))
                margin = np.bincount(rows, size * weights[feature], n) / norm + bias
                scores.append(1 / (1 + np.exp(-margin)))
            names = [c for c in batch.schema.names if c != "text"]
            scored = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), scored], names=[*names, "score"])

    return score


def scored(
    docs: DataFrame, labels: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    features: int = FEATURES, rows_per_class: int = ROWS_PER_CLASS, smoothing: float = 1.0,
) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every row of ``docs``.

    ``trains`` says over ``labels`` which labelled rows may be learned from.
    """
    own = labels.where(F.coalesce(trains, F.lit(False)) & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    own = own.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    totals = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    plain = texts.select(F.col("id").alias("doc_id"))
    if len(totals) < 2:
        return plain.withColumn("score", F.lit(1.0 if 1 in totals else 0.0 if 0 in totals else 0.5))
    in_order = lambda value: own.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(rows_per_class)
    # At most twice rows_per_class ids.
    train = texts.join(F.broadcast(in_order(0).unionByName(in_order(1))), "id").select("text", "label")
    slices = train.mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect()
    counts = np.zeros((_SLICES, 2, (1 << BUCKET_BITS) // _SLICES))
    for s in slices:
        counts[s["slice"]] = np.frombuffer(s["counts"], np.int64).reshape(2, -1)
    counts = counts.transpose(1, 0, 2).reshape(2, -1)
    seen = np.maximum(counts.sum(1), 0)
    if not seen.all():
        return plain.withColumn("score", F.lit(totals[1] / (totals[0] + totals[1])))
    documents = np.array([min(totals[0], rows_per_class), min(totals[1], rows_per_class)])
    rates = (counts + smoothing) / (documents[:, None] + 2 * smoothing)
    log_ratio = np.log(rates[1] / rates[0])
    # How surely a bucket tells the classes apart: the ratio in units of its own error.
    surety = np.abs(log_ratio) / np.sqrt((1 / (counts + smoothing)).sum(0))
    best = np.argsort(-surety, kind="stable")[:features]
    best = best[surety[best] > 0]
    feature_of = np.full(1 << BUCKET_BITS, -1, np.int32)
    feature_of[best] = np.arange(len(best))
    ratio = log_ratio[best]
    fitted = (
        train.mapInArrow(_chosen(feature_of), "label int, features binary").withColumn("all", F.lit(0))
        .groupBy("all").applyInArrow(_fit(ratio), "weights binary, bias double").first()
    )
    prior = np.log(totals[1] / totals[0])
    score = _scorer(feature_of, ratio, np.frombuffer(fitted["weights"]), fitted["bias"] + 0.5 * prior)
    out = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(score, f"id {out}, score double").withColumnRenamed("id", "doc_id")
