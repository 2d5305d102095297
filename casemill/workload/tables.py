"""Case records and workflow tables derived from the driver tables.

The driver tables are a retail star schema. One line item becomes one case; its dimensions give the
categories. All dimension keys are unique, so a left join to a dimension never changes the rows and
is left out when none of its columns is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.schema import CASE_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns() -> dict[str, Column]:
    status = F.col("o_orderstatus")
    third = F.col("l_linenumber") % 3
    return {
        "case_id": F.col("l_orderkey"),
        "opened_on": F.col("o_orderdate").cast("date"),
        "closed_on": F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("date")),
        "status": F.when(status == "F", F.lit("cerrado"))
        .when(status == "P", F.lit("en_proceso"))
        .when(status == "O", F.lit("abierto")),
        "cause": F.col("p_brand"),
        "channel": F.col("c_mktsegment"),
        "company": F.col("n_name"),
        "outcome": F.when(F.col("l_returnflag") == "R", F.lit("accede")).when(
            F.col("l_returnflag") == "A", F.lit("no_accede")
        ),
        "owner_unit": F.col("s_name"),
        "marking": F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")),
        "close_reason": F.when(status == "F", F.col("l_returnflag")),
        "handling_days": F.col("l_quantity"),
        "case_type": F.when(third == 0, F.lit("peticion")).when(third == 1, F.lit("queja")).otherwise(F.lit("reclamo")),
    }


_ORDER_COLUMNS = {"opened_on", "status", "channel", "company", "marking", "close_reason"}


def cases(spark: SparkSession, sf_dir: str, *wanted: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """The case view, or only the wanted columns of it; ``extra`` are columns over the line items."""
    names = list(wanted) or CASE_COLUMNS
    need = set(names)
    df = table(spark, sf_dir, "lineitem")
    if need & _ORDER_COLUMNS:
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if need & {"channel", "company"}:
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if "company" in need:
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if "cause" in need:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "owner_unit" in need:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    columns = _columns()
    return df.select(*[columns[n].alias(n) for n in names], *[c.alias(n) for n, c in (extra or {}).items()])


CASES = """
cases AS (
  SELECT l_orderkey AS case_id, CAST(o_orderdate AS DATE) AS opened_on,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS closed_on,
         CASE o_orderstatus WHEN 'F' THEN 'cerrado' WHEN 'P' THEN 'en_proceso' WHEN 'O' THEN 'abierto' END AS status,
         p_brand AS cause, c_mktsegment AS channel, n_name AS company,
         CASE l_returnflag WHEN 'R' THEN 'accede' WHEN 'A' THEN 'no_accede' END AS outcome,
         s_name AS owner_unit,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS marking,
         CASE WHEN o_orderstatus = 'F' THEN l_returnflag END AS close_reason,
         l_quantity AS handling_days,
         CASE l_linenumber % 3 WHEN 0 THEN 'peticion' WHEN 1 THEN 'queja' ELSE 'reclamo' END AS case_type
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""


def with_cases(body: str, *ctes: str) -> str:
    """SQL over the case view, with further CTEs in between."""
    return "WITH " + ",\n".join([CASES.strip(), *ctes]) + "\n" + body
