"""Sources: reading tabular files, describing and checking them, joining parts of unequal schema."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casemill.functions.numbers import finite, to_double
from casemill.functions.text import normalize_status, spreadsheet_date
from casemill.schema import CASE_SCHEMA, SOURCE_NAMES
from casemill.sources import digests

ROW_BYTES = 128 * 2**20
FORMATS = ("csv", "json", "parquet", "orc", "text")
_SUFFIXES = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet",
             "orc": "orc", "txt": "text"}
AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
    ]
)


def detect_format(path: str) -> str:
    """Format by file suffix; a directory names it through its own suffix or needs ``fmt``."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in _SUFFIXES:
        raise ValueError(f"cannot tell the format of {path}; expected one of {sorted(_SUFFIXES)}")
    return _SUFFIXES[suffix]


def read_source(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Read a file or directory. Text formats arrive as strings unless a schema is given."""
    fmt = fmt or detect_format(path)
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE")
        if path.lower().endswith(".tsv"):
            reader = reader.option("sep", "\t")
    for key, value in options.items():
        reader = reader.option(key, value)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The curated case table; the fixed schema avoids a pass for inference."""
    return spark.read.schema(CASE_SCHEMA).parquet(path)


def source_files(
    spark: SparkSession,
    path: str,
    glob: str = "*",
    by: str = "content",
    row_bytes: int = ROW_BYTES,
    range_bytes: int = digests.RANGE_BYTES,
    opener: digests.Opener = digests.open_file,
) -> DataFrame:
    """Files with size and SHA-256, hashed where they are read.

    ``by="content"`` is the SHA-256 of all bytes: files of at most ``row_bytes`` travel as one row, larger
    ones are streamed by a task each. ``by="tree"`` hashes byte ranges of ``range_bytes`` in parallel and
    joins them as a tree, for files too large for one task. ``by="listing"`` hashes path, size and
    modification time instead and reads nothing, for sources too large to be read twice. Empty files are not
    listed, since Spark plans no read of them. ``opener`` opens
    a path of a store that pyarrow does not know.
    """
    files = digests.list_files(spark, path, glob)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")
    facts = [name, "path", F.col("length").alias("bytes")]
    if by == "listing":
        parts = [F.col("path"), F.col("length").cast("string"), F.col("modificationTime").cast("string")]
        return files.select(*facts, F.sha2(F.concat_ws("|", *parts), 256).alias("sha256"))
    if by == "tree":
        listed = files.select("path", "length")
        return listed.join(digests.tree_digests(listed, range_bytes, opener=opener), "path").select(*facts, "sha256")
    if by != "content":
        raise ValueError(f"unknown fingerprint {by}; expected content, tree or listing")
    held = files.where(F.col("length") <= row_bytes).select(*facts, F.sha2(F.col("content"), 256).alias("sha256"))
    large = files.where(F.col("length") > row_bytes).select("path", "length")
    return held.unionByName(large.join(digests.stream_digests(large, opener), "path").select(*facts, "sha256"))


def source_digest(files: DataFrame) -> DataFrame:
    """One row for a set of files: the file's own hash, or a hash of all of them in any order.

    The combination keeps a count and two folded numbers, never a list of files.
    """
    number = F.xxhash64("sha256")
    folded = F.concat_ws(
        ":",
        F.count(F.lit(1)).cast("string"),
        F.bit_xor(number).cast("string"),
        F.sum(F.pmod(number, F.lit(2**31))).cast("string"),
    )
    single = F.count(F.lit(1)) == 1
    return files.agg(
        F.when(single, F.min("sha256")).otherwise(F.sha2(folded, 256)).alias("sha256"),
        F.min("file_name").alias("file_name"),
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
    )


def source_metadata(spark: SparkSession, paths: Mapping[str, str], fmt: str | None = None) -> DataFrame:
    """One row per named part: records, columns, bytes and hash of its files."""
    rows: DataFrame | None = None
    for part, path in paths.items():
        df = read_source(spark, path, fmt)
        counted = df.agg(F.count(F.lit(1)).alias("records"))
        files = source_digest(source_files(spark, path))
        row = counted.crossJoin(files).select(  # one row each
            F.lit(part).alias("part"),
            "records",
            F.lit(len(df.columns)).cast("long").alias("columns"),
            F.lit(",".join(f"{n}:{t}" for n, t in df.dtypes)).alias("schema"),
            "files",
            "bytes",
            "sha256",
        )
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        raise ValueError("no parts given")
    return rows


def validate_source(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Problems of a source as (level, message); no row of level ``error`` means it can be read."""
    problems: list[tuple[str, str]] = []
    try:
        fmt = fmt or detect_format(path)
        files = source_files(spark, path)
        sizes = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bytes") == 0).alias("empty")).first()
        if not sizes["n"]:
            problems.append(("error", "no files"))
        elif sizes["empty"]:
            problems.append(("warning", f"{sizes['empty']} empty files"))
        if sizes["n"]:
            df = read_source(spark, path, fmt)
            if not df.columns:
                problems.append(("error", "no columns"))
            elif df.isEmpty():
                problems.append(("error", "no part holds a record"))
            unnamed = [c for c in df.columns if not c.strip() or c.startswith("_c")]
            if unnamed:
                problems.append(("warning", f"{len(unnamed)} columns without a name"))
    except Exception as error:  # noqa: BLE001  any reader failure is a finding about the source
        problems.append(("error", f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(problems, "level string, message string")


# Wider types win; anything mixed with text becomes text.
_RANK = {"boolean": 0, "tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


def _common_type(kinds: set[str]) -> str:
    if len(kinds) == 1:
        return next(iter(kinds))
    if kinds <= set(_RANK) and "boolean" not in kinds:
        return max(kinds, key=_RANK.__getitem__) if "float" not in kinds else "double"
    if kinds <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp"
    return "string"


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name. Missing columns are null, unequal types widen to a common one."""
    used = [p for p in parts if p.columns]
    if not used:
        raise ValueError("no part has columns")
    kinds: dict[str, set[str]] = {}
    for part in used:
        for name, kind in part.dtypes:
            kinds.setdefault(name, set()).add(kind)
    target = {name: _common_type(k) for name, k in kinds.items()}
    whole: DataFrame | None = None
    for part in used:
        typed = part.select(*[F.col(f"`{n}`").cast(target[n]).alias(n) for n in part.columns])
        whole = typed if whole is None else whole.unionByName(typed, allowMissingColumns=True)
    return whole


def standard_names(names: Sequence[str]) -> list[str]:
    """snake_case column names; a name used twice gets a number."""
    taken: set[str] = set()
    result: list[str] = []
    for position, name in enumerate(names):
        base = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or f"column_{position}"
        unique, copy = base, 2
        while unique in taken:
            unique, copy = f"{base}_{copy}", copy + 1
        taken.add(unique)
        result.append(unique)
    return result


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def rename_columns(df: DataFrame, mapping: Mapping[str, str] = SOURCE_NAMES) -> DataFrame:
    """Rename the columns that are present."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def verify_integrity(source: DataFrame, output: DataFrame, part: str = "part") -> DataFrame:
    """Rows and columns lost per part between source and output."""
    counted = source.groupBy(part).agg(F.count(F.lit(1)).alias("source_records"))
    arrived = output.groupBy(part).agg(F.count(F.lit(1)).alias("_arrived"))
    lost_columns = len(source.columns) - len(output.columns)
    arrived_records = F.coalesce("_arrived", F.lit(0))
    return counted.join(arrived, part, "left").select(
        part,
        "source_records",
        arrived_records.alias("output_records"),
        (F.col("source_records") - arrived_records).alias("record_diff"),
        F.lit(lost_columns).cast("long").alias("column_diff"),
        ((F.col("source_records") == arrived_records) & F.lit(lost_columns == 0)).alias("is_valid"),
    )


def normalize_cases(df: DataFrame, mapping: Mapping[str, str] = SOURCE_NAMES) -> DataFrame:
    """Rename, then bring ids, times, status and dates to the contract types in one projection."""
    renamed = rename_columns(df, mapping)
    columns = []
    for name, kind in renamed.dtypes:
        c = F.col(f"`{name}`")
        if name == "case_id":
            c = to_double(c).cast("long") if kind == "string" else c.cast("long")
        elif name == "handling_days":
            c = finite(c) if kind == "double" else to_double(c)
        elif name == "status":
            c = normalize_status(c)
        elif name in ("opened_on", "closed_on"):
            c = c.cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else spreadsheet_date(c)
        columns.append(c.alias(name))
    return renamed.select(*columns)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events from JSON lines; malformed lines are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
