"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SMALL_ROWS = 100_000
SMALL_BYTES = 32 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """Ask for a broadcast of a rule or catalog table after measuring that it is small, in rows and in bytes.

    Such tables have few keys, so a shuffle on them would put most facts in a few tasks, and Spark
    does not know the size of rows that come from the driver. A table that turns out larger is
    returned as it is and joined by shuffle, where AQE splits skewed keys. Bytes are those of the rows as JSON
    with the names of columns, and at most ``rows`` + 1 rows are measured.
    """
    length = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(length)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df
