"""Digests of files of any size: byte ranges hashed in parallel and joined as a tree, or one stream per file."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 * 2**20
FANOUT = 1024
READ_BYTES = 4 * 2**20
# What is hashed before the bytes of a range and before the digests below a node: a file can never pass for a node.
LEAF, NODE = b"\x00", b"\x01"
Opener = Callable[[str], BinaryIO]


def open_file(path: str) -> BinaryIO:
    """Open a file of any store that pyarrow knows; paths are as Spark lists them, not percent-encoded."""
    parts = re.fullmatch(r"([A-Za-z][\w+.-]*):(?://([^/]*))?(/.*)", path)
    if parts is None or parts[1] == "file":
        return fs.LocalFileSystem().open_input_file(parts[3] if parts else path)
    store, root = fs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', parts[1])}://{parts[2] or ''}/")
    return store.open_input_file(root.rstrip("/") + parts[3])


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime, content) of files; contents are read only where they are selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def _hash_ranges(opener: Opener, read_bytes: int, prefix: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "_start", "_bytes"))):
                digest, left = hashlib.sha256(prefix), size
                with opener(path) as file:
                    file.seek(start)
                    while left > 0:
                        data = file.read(min(left, read_bytes))
                        if not data:
                            raise OSError(f"{path} ends {left} bytes before its listed length")
                        digest.update(data)
                        left -= len(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "_sha"])

    return run


def _hashed(ranges: DataFrame, opener: Opener, read_bytes: int, prefix: bytes) -> DataFrame:
    """Add ``_sha`` to rows of (path, _no, _start, _bytes); a task holds one buffer, whatever it reads."""
    # The rows are tiny, the work behind them is not: a fixed number of partitions is never merged.
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ranges.repartition(parts, "path", "_no")
    schema = "path string, _no long, _start long, _bytes long, _sha string"
    return spread.select("path", "_no", "_start", "_bytes").mapInArrow(_hash_ranges(opener, read_bytes, prefix), schema)


def stream_digests(files: DataFrame, opener: Opener = open_file, read_bytes: int = READ_BYTES) -> DataFrame:
    """(path, sha256): the plain SHA-256 of each file, read in parts by one task per file.

    SHA-256 is sequential, so one file is never faster than one task; :func:`tree_digests` is.
    """
    whole = files.select("path", F.lit(0).cast("long").alias("_no"), F.lit(0).cast("long").alias("_start"),
                         F.col("length").alias("_bytes"))
    return _hashed(whole, opener, read_bytes, b"").select("path", F.col("_sha").alias("sha256"))


def range_digests(
    files: DataFrame, range_bytes: int = RANGE_BYTES, opener: Opener = open_file, read_bytes: int = READ_BYTES
) -> DataFrame:
    """(path, range_no, start, bytes, sha256): digests of fixed byte ranges, the ranges of a file in many tasks.

    An empty file has one empty range.
    """
    last = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1)) - 1
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_no"))
    start = F.col("_no") * F.lit(range_bytes).cast("long")
    cut = ranges.select("path", "_no", start.alias("_start"), F.least(F.col("length") - start, F.lit(range_bytes)).alias("_bytes"))
    return _hashed(cut, opener, read_bytes, LEAF).select(
        "path", F.col("_no").alias("range_no"), F.col("_start").alias("start"), F.col("_bytes").alias("bytes"),
        F.col("_sha").alias("sha256"),
    )


def tree_digests(
    files: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, opener: Opener = open_file,
    read_bytes: int = READ_BYTES,
) -> DataFrame:
    """(path, sha256): root of a hash tree over the byte ranges of each file.

    A node is the hash of its at most ``fanout`` children in order; a node of one child is that child. The
    digest depends on ``range_bytes`` and ``fanout``, so both must stay the same between runs. No task and
    no group sees more than one range or ``fanout`` digests.
    """
    if range_bytes < 1 or fanout < 2:
        raise ValueError("range_bytes must be positive and fanout at least 2")
    longest = files.agg(F.max("length").alias("n")).first()["n"] or 0
    nodes = range_digests(files, range_bytes, opener, read_bytes).select("path", F.col("range_no").alias("_no"), "sha256")
    width = -(-longest // range_bytes)
    while width > 1:
        children = F.sort_array(F.collect_list(F.struct("_no", "sha256")))
        joined = F.concat(F.lit(NODE), F.array_join(children["sha256"], "").cast("binary"))
        nodes = (
            nodes.groupBy("path", F.floor(F.col("_no") / fanout).alias("_up"))
            .agg(F.when(F.count(F.lit(1)) == 1, F.min("sha256")).otherwise(F.sha2(joined, 256)).alias("sha256"))
            .withColumnRenamed("_up", "_no")
        )
        width = -(-width // fanout)
    return nodes.select("path", "sha256")
