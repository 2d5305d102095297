"""Masking of personal data found by column name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Patterns of column names that hold personal data.
PII_PATTERNS = (
    r".*nombre.*",
    r".*telefono.*",
    r".*celular.*",
    r".*direccion.*",
    r".*cedula.*",
    r".*nit.*",
    r".*email.*",
    r".*correo.*",
)


def pii_columns(df: DataFrame, patterns: Sequence[str] = PII_PATTERNS) -> list[str]:
    """Columns whose whole name matches a pattern, ignoring case."""
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
    return [c for c in df.columns if any(p.fullmatch(c) for p in compiled)]


def pii_report(df: DataFrame, patterns: Sequence[str] = PII_PATTERNS) -> DataFrame:
    """One row per column that holds personal data, with its filled and masked-by-hash value counts."""
    found = pii_columns(df, patterns)
    if not found:
        return df.sparkSession.createDataFrame([], "column_name string, values long, hashed long")
    counts = []
    for c in found:
        text = F.col(c).cast("string")
        counts += [F.count(text).alias(f"{c}__n"), F.count_if(F.length(text).between(1, 2)).alias(f"{c}__h")]
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("values"), F.col(f"{c}__h").alias("hashed")) for c in found]
    )
    return df.agg(*counts).select(F.inline(rows))


def mask(value: Column) -> Column:
    """First and last character with stars between; one or two characters become a short hash."""
    text = value.cast("string")
    length = F.length(text)
    starred = F.concat(F.substring(text, 1, 1), F.repeat(F.lit("*"), length - 2), F.right(text, F.lit(1)))
    return (
        F.when(length >= 3, starred)
        .when(length > 0, F.substring(F.sha2(text, 256), 1, 8))
        .otherwise(text)
    )


def mask_table(df: DataFrame, patterns: Sequence[str] = PII_PATTERNS) -> DataFrame:
    """Mask every column that holds personal data. The expression cannot fail on a row, so none is lost."""
    return df.withColumns({c: mask(F.col(f"`{c}`")) for c in pii_columns(df, patterns)})
