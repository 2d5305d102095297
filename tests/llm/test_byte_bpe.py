"""Byte-level BPE against the tokeniser library, and exact round trips."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from casemill.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rnd = random.Random(11)
    letters = list("abst'relvmdAB  \n\t　 é1٣.,!-_#漢字") + ["'s", "'re", "'LL", " '", "  ", "\U00010d40", "🙂"]
    found = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [*found, "", None, " ", "\n\n", "a", "a" * 300, "thereou " * 200, "x" * 5_000 + "'ve", "word " * 60_000, "<|endoftext|>"]


def test_splits_as_the_pattern_does():
    import zlib

    import numpy as np

    assert byte_bpe.SPLIT == public_tokenizers.PATTERN
    classes = np.frombuffer(zlib.decompress(byte_bpe._packed_classes()), np.uint8)
    some = [t or "" for t in texts()]
    words, ends = byte_bpe.split_words(pa.array(some), classes)
    # The pattern library may know a later Unicode; no such letter is in these texts.
    want = [regex.findall(byte_bpe.SPLIT, t) for t in some]
    assert [w.decode() for w in words.to_pylist()] == [w for row in want for w in row]
    assert np.diff(ends, prepend=0).tolist() == [len(row) for row in want]


@pytest.mark.parametrize("fold_bytes, chunk_bytes", [(byte_bpe.FOLD_BYTES, byte_bpe.CHUNK_BYTES), (4, 50)])
def test_encodes_as_the_library_and_back(spark, fold_bytes, chunk_bytes):
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts())] + [(None, "null id", 1, "x", 2), (3, "again", 1, "x", 2), (3, "again", 1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, words string, place int").repartition(4)
    encoded = byte_bpe.encoded(df, PATH, fold_bytes=fold_bytes, chunk_bytes=chunk_bytes)
    found = byte_bpe.decoded(encoded, PATH).collect()
    want = sorted((repr(i), LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded)) for r in found) == want


def test_empty_table_other_ids_and_unknown_tokens(spark):
    assert byte_bpe.encoded(spark.createDataFrame([], "doc_id string, text string"), PATH).count() == 0
    (row,) = byte_bpe.encoded(spark.createDataFrame([("k", "the")], "doc_id string, text string"), PATH).collect()
    assert row.doc_id == "k" and row.ids == LIBRARY.encode_ordinary("the")
    ids = spark.createDataFrame([(1, [1, 2]), (2, [60_000]), (3, None), (4, []), (5, [-1])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in byte_bpe.decoded(ids, PATH).collect()}
    assert bytes(got[1]) == LIBRARY.decode_bytes([1, 2]) and got[2] is None and got[3] is None and bytes(got[4]) == b"" and got[5] is None
    sums = {r.doc_id: r for r in byte_bpe.digests(ids, PATH).collect()}
    assert sums[2].n_tokens == 1 and sums[2].decoded_sha256 is None and sums[3].n_tokens is None


def test_fold_equals_heap(spark):
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abcdeth ns") for _ in range(rnd.randint(1, 24))) for _ in range(300)] + [bytes([b]) for b in range(256)]
    df = spark.createDataFrame([(w,) for w in words], "word binary").select("word", byte_bpe.folded(F.col("word"), RANKS).alias("ids"))
    for r in df.collect():
        assert r.ids == byte_bpe.merged_by_heap(bytes(r.word), RANKS)
