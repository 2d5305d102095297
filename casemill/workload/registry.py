"""Query registry shared by the entry file, the benchmark and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under a stable name, with the SQL that must give the same rows."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def rnd(expression: str, places: int) -> str:
    """SQL text of :func:`casemill.functions.numbers.round_to`."""
    scale = f"{10**places}e0"
    return f"round(({expression}) * {scale}) / {scale}"
