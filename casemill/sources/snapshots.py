"""Snapshots of an append-only log with a tree of digests per range of ids beside the rows.

Rows are stored by ranges of ids. The digest of a range is the number of its rows and the sum of their SHA-256 in
eight lanes, so it needs no order, is built by one map-side combined aggregation, and the digest of a node of the
tree is the sum of those below it. Two snapshots are compared from their trees: rows are read only of ranges whose
digests differ, by partition pruning.

Sums tell accidental changes and edits; they do not resist one who can search for rows with a given sum.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, ByteType, DataType, IntegerType, LongType, MapType, ShortType, StructField, StructType,
    TimestampType, VariantType,
)

RANGE_BITS = 20
NODE_BITS = 5
LEVELS = 5
#: Nodes that a comparison may name in the filter of its scans; with more it takes the next level of the tree.
NODES = 512
_LANES = [f"s{i}" for i in range(8)]
_NO_ID = -(1 << 62)
_EXACT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _as_text(name: str, kind: DataType) -> Column:
    """A text that differs wherever the value does."""
    value = F.col(f"`{name}`")
    if isinstance(kind, BinaryType):
        return F.hex(value)
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, (ArrayType, MapType, StructType, VariantType)):
        return F.to_json(F.struct(value), _EXACT)
    return value.cast("string")


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row: every value with its length, so that neighbours cannot run into each other."""
    parts = []
    for field in df.schema.fields:
        text = _as_text(field.name, field.dataType)
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(F.lit("row"), *parts), 256)


def write_snapshot(df: DataFrame, path: str, key: str = "event_id", range_bits: int = RANGE_BITS) -> None:
    """Store rows and digests; a range is 2**``range_bits`` neighbouring values of the whole-number ``key``.

    Rows without a key are a range of their own. The rows are written first, the tree is built from them, and the
    columns and the width of the ranges come last: an interrupted write leaves a snapshot that cannot be read.
    """
    if not isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{key} is no whole number")
    if "_range" in df.columns:
        raise ValueError("the column name _range is taken")
    spark = df.sparkSession
    at = F.coalesce(F.shiftright(F.col(f"`{key}`").cast("long"), range_bits), F.lit(_NO_ID))
    # AQE splits large ranges and merges small ones: few files a range, whatever the order of the rows.
    df.withColumn("_range", at).hint("rebalance", "_range").write.partitionBy("_range").parquet(f"{path}/rows")
    stored = _rows(spark, path, df.schema)
    sha = row_digest(df)
    # 2**31 rows of a node are the limit of a lane; beyond it the sum ends in an overflow error, not in a wrong digest.
    lanes = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(_LANES)]
    sums = [F.sum(s).alias(s) for s in _LANES]
    ranges = stored.select("_range", *lanes).groupBy("_range").agg(F.count(F.lit(1)).alias("n"), *sums)
    node = F.expr(f"shiftright(_range, level * {NODE_BITS})")
    tree = (
        ranges.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
        .groupBy("level", node.alias("node"))
        .agg(F.sum("n").alias("n"), *sums)
        .withColumn("range_bits", F.lit(range_bits))
    )
    tree.write.partitionBy("level").parquet(f"{path}/digests")
    facts = spark.createDataFrame([(range_bits, df.schema.json())], "range_bits int, schema string")
    facts.coalesce(1).write.parquet(f"{path}/facts")


def _facts(spark: SparkSession, path: str) -> tuple[int, StructType]:
    """Width of the ranges and columns of a complete snapshot."""
    facts = spark.read.schema("range_bits int, schema string").parquet(f"{path}/facts").first()
    return facts["range_bits"], StructType.fromJson(json.loads(facts["schema"]))


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("_range", LongType())])).parquet(f"{path}/rows")


def _tree(spark: SparkSession, path: str) -> DataFrame:
    lanes = ", ".join(f"{s} long" for s in _LANES)
    return spark.read.schema(f"node long, n long, {lanes}, range_bits int, level int").parquet(f"{path}/digests")


def differing_nodes(spark: SparkSession, old: str, new: str, most: int = NODES) -> tuple[int, list[int]] | None:
    """(level, nodes) of the older tree that the newer one has not, at the lowest level with at most ``most`` of them;
    None if the top level has more."""
    facts = ["level", "node", "n", *_LANES, "range_bits"]
    for level in range(LEVELS):
        own, other = (_tree(spark, p).where(F.col("level") == level).select(facts) for p in (old, new))
        found = own.join(other, facts, "left_anti").select("node").limit(most + 1).collect()
        if len(found) <= most:
            return level, sorted(r["node"] for r in found)
    return None


def snapshot_violations(spark: SparkSession, old: str, new: str, most: int = NODES) -> DataFrame:
    """Rows of the older snapshot that the newer one has lost or changed, as often as they are missing.

    The newer one may have more columns, in any order; its rows are compared in the columns of the older one. Rows
    are read of differing ranges only (of nodes above them where more than ``most`` differ).
    """
    (width, before), (other_width, after) = (_facts(spark, p) for p in (old, new))
    rows, others = _rows(spark, old, before), _rows(spark, new, after)
    nodes = differing_nodes(spark, old, new, most)
    if nodes is not None:
        level, listed = nodes
        same_ranges = F.expr(f"shiftright(_range, {level * NODE_BITS})").isin(listed) if listed else F.lit(False)
        rows = rows.where(same_ranges)
        # Ranges of another width do not line up.
        if width == other_width:
            others = others.where(same_ranges)
    return rows.drop("_range").exceptAll(others.select(*[F.col(f"`{c}`") for c in before.names]))
