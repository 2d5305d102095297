"""Membership index of a Parquet table: which of its files may hold a key.

Every file has a Bloom filter over the key columns, stored as rows (file, words, word, bits) in the folder
``_membership`` of the table, which readers of the table skip. A key sets a few bits of one 64-bit word, so
filters are built, and could be merged, by ``bit_or``, and a probe is an equi-join on the word. A file without a filter
(written by someone else, or before the index of a failed run) may hold anything; filters of files that are
gone are ignored. Files that may hold one of the wanted keys are then read and joined exactly, so a false
positive costs a read and never a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, StructType

INDEX = "_membership"
BITS_PER_KEY = 16
BITS_SET = 6
# ``lo`` and ``hi`` are the bounds of the first key, if it is a whole number, in the row of a file that has no bits.
_SCHEMA = "file string, words long, word long, bits long, lo long, hi long"
_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _key(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Key columns such that equal keys have equal hashes (both zeros of a floating number are equal)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [F.col(k) + F.lit(0.0).cast(types[k]) if isinstance(types[k], (DoubleType, FloatType)) else F.col(k) for k in keys]


def _word(key: list[Column], words: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("word"), *key), words)


def _mask(key: list[Column]) -> Column:
    spread = F.xxhash64(F.lit("bits"), *key)
    mask = F.lit(0).cast("long")
    for at in range(BITS_SET):
        place = F.shiftrightunsigned(spread, 6 * at).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def _named(file: Column) -> Column:
    """A file by the part of its path that its folder does not change."""
    return F.substring_index(file, "/", -1)


def stored_files(spark: SparkSession, path: str) -> list[str]:
    """Files of the table at ``path``; none before the first write."""
    try:
        return spark.read.parquet(path).inputFiles()
    except AnalysisException as missing:
        if missing.getCondition() not in _MISSING:
            raise
        return []


def _read(spark: SparkSession, path: str, schema: StructType, files: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(*files)


def index_files(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], bits_per_key: int = BITS_PER_KEY) -> None:
    """Give every file of the table that has none a filter over ``keys``.

    All files of a call get filters of one size, a power of two of words, from the largest number of their rows.
    """
    known = _indexed(_index(spark, path))
    new = [f for f in stored_files(spark, path) if f.rsplit("/", 1)[-1] not in known]
    if not new:
        return
    rows = _read(spark, path, schema, new)
    of_file = rows.select(_named(F.input_file_name()).alias("file"), *keys)
    whole = F.col(keys[0]).cast("long") if _ranged(schema, keys) else F.lit(None).cast("long")
    facts = of_file.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    found = {r["file"]: r for r in facts.collect()}  # one row per file
    most = max((r["n"] for r in found.values()), default=0)
    words = 1 << max(0, -(-most * bits_per_key // 64) - 1).bit_length()
    key = _key(rows, keys)
    marked = of_file.select("file", F.lit(words).cast("long").alias("words"), _word(key, F.lit(words)).alias("word"), _mask(key).alias("bits"))
    unknown = F.lit(None).cast("long")
    filters = marked.groupBy("file", "words", "word").agg(F.bit_or("bits").alias("bits")).select("*", unknown.alias("lo"), unknown.alias("hi"))
    # A file without rows holds nothing: a word without bits tells so.
    names = [f.rsplit("/", 1)[-1] for f in new]
    empty = spark.createDataFrame([(f, 1, 0, 0, *((found[f]["lo"], found[f]["hi"]) if f in found else (None, None))) for f in names], _SCHEMA)
    # Sorted, so that readers of the rows without bits or of some files skip the others.
    stored = filters.union(empty).repartition(max(1, len(new) // 16), "file").sortWithinPartitions("words", "file")
    stored.write.mode("append").parquet(f"{path}/{INDEX}")


def _ranged(schema: StructType, keys: Sequence[str]) -> bool:
    return isinstance(schema[keys[0]].dataType, IntegralType)


def _indexed(index: DataFrame) -> dict[str, tuple[int | None, int | None]]:
    """The files that have a filter, with the bounds of their first key: one row per file."""
    rows = index.where("words = 1 AND bits = 0").select("file", "lo", "hi").distinct().collect()
    return {r["file"]: (r["lo"], r["hi"]) for r in rows}


def overlapping_files(wanted: DataFrame, path: str, schema: StructType, keys: Sequence[str], files: Sequence[str]) -> list[str]:
    """Those of the table's ``files`` whose bounds meet those of the ``wanted`` keys, or that have none.

    Where ids grow with time, no later work is done for the files of earlier loads.
    """
    if not files or not _ranged(schema, keys):
        return list(files)
    bounds = _indexed(_index(wanted.sparkSession, path))
    key = F.col(keys[0]).cast("long")
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    if low is None:
        return list(files)
    near = []
    for f in files:
        lo, hi = bounds.get(f.rsplit("/", 1)[-1], (None, None))
        if lo is None or (lo <= high and low <= hi):
            near.append(f)
    return near


def _index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).parquet(f"{path}/{INDEX}")
    except AnalysisException as missing:
        if missing.getCondition() not in _MISSING:
            raise
        return spark.createDataFrame([], _SCHEMA)


def candidate_files(wanted: DataFrame, path: str, schema: StructType, keys: Sequence[str], files: Sequence[str] | None = None) -> list[str]:
    """Those of the table's ``files`` that may hold one of the ``wanted`` keys."""
    spark = wanted.sparkSession
    files = stored_files(spark, path) if files is None else list(files)
    if not files:
        return []
    index = _index(spark, path)
    known = _indexed(index)
    index = index.where(F.col("file").isin([f.rsplit("/", 1)[-1] for f in files]))
    sizes = index.select("words").distinct()
    # Few sizes: powers of two.
    asked = wanted.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in keys])
    key = _key(asked, keys)
    probes = asked.crossJoin(F.broadcast(sizes)).select(
        F.col("words").alias("_words"), _word(key, F.col("words")).alias("_word"), _mask(key).alias("_mask")
    ).distinct()
    hit = (F.col("words") == F.col("_words")) & (F.col("word") == F.col("_word")) & (F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    hits = {r["file"] for r in index.join(probes, hit, "left_semi").select("file").distinct().collect()}
    return [f for f in files if (name := f.rsplit("/", 1)[-1]) in hits or name not in known]


def holding(wanted: DataFrame, path: str, schema: StructType, keys: Sequence[str], files: Sequence[str] | None = None) -> DataFrame | None:
    """Keys of the table that may be wanted, read from its candidate files alone; None if there is no such file."""
    chosen = candidate_files(wanted, path, schema, keys, files)
    if not chosen:
        return None
    return _read(wanted.sparkSession, path, schema, chosen).select(*keys)
