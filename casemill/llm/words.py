"""Words of texts in Arrow batches: runs of anything but space and the bytes 9 to 13."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes together; a longer text is a range itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of words up to the end of each text); a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py() and len(words):
        ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][ends]
        words = words.filter(full)
    return words, ends


_BYTE_VALUES = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for place, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[place] = np.cumprod(factors, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Fingerprints:
    """Fingerprints of any substrings of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        powers, self.inverse = _power_tables(len(data) + 1)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=self.upto[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.upto[stop] - self.upto[start]) * self.inverse[start])


def word_fingerprints(words: pa.Array) -> np.ndarray:
    """One 64-bit number per word, equal for equal words in every task."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    return Fingerprints(data).of(offsets[:-1], offsets[1:])
