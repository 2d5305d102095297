"""Pareto tables.

A running total needs an order, and an unpartitioned window would put every group in one task. The
order here is by count, and groups of equal count share their place, so the running total is taken
over the *distinct counts* instead: n rows can hold at most sqrt(2n) different group sizes (about
1.4 million for a trillion rows), whatever the number of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casemill.functions.numbers import round_to, share
from casemill.functions.ordering import with_running_total
from casemill.operators.charts import group_counts
from casemill.schema import HIGH_CONCENTRATION, MIN_GROUP, PARETO_CUT

ANALYSIS_LEVEL = "statistical_concentration"


def cumulate(groups: DataFrame) -> DataFrame:
    """Add to (…, count): ``above`` rows in larger groups, ``upto`` including equal ones, ``total``."""
    sizes = groups.groupBy("count").agg((F.col("count") * F.count(F.lit(1))).alias("rows"))
    everything = Window.orderBy(F.desc("count"))
    places = sizes.select(
        "count",
        F.sum("rows").over(everything.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        "rows",
        F.sum("rows").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    ).select("count", "upto", (F.col("upto") - F.col("rows")).alias("above"), "total")
    return groups.join(places, "count")


def pareto(
    df: DataFrame,
    column: str = "cause",
    min_group: int = MIN_GROUP,
    threshold: float = HIGH_CONCENTRATION,
    keep_null: bool = False,
) -> DataFrame:
    """Share and running share of the surviving groups; equal counts share the running share."""
    ranked = cumulate(group_counts(df, column, min_group=min_group, keep_null=keep_null))
    # The first name among the largest groups: one row.
    name = F.struct(F.col(column).isNotNull().alias("known"), F.col(column).alias("name"))
    lead = ranked.where("above = 0").agg(F.min(name).alias("_lead"))
    ranked = ranked.crossJoin(F.broadcast(lead))
    leads = (F.col("above") == 0) & F.col(column).eqNullSafe(F.col("_lead.name"))
    pct = round_to(share(F.col("count"), F.col("total")), 2)
    return ranked.select(
        column,
        "count",
        pct.alias("percentage"),
        round_to(share(F.col("upto"), F.col("total")), 2).alias("cumulative_pct"),
        (leads & (pct / 100 > threshold)).alias("high_concentration"),
        pct.alias("concentration_pct"),
        F.lit(ANALYSIS_LEVEL).alias("analysis_level"),
    ).orderBy(F.desc("count"), column)


def _in_order(groups: DataFrame, column: str) -> DataFrame:
    """Place every group in strict order: count descending, then name."""
    ordered = with_running_total(groups, [F.desc("count"), F.col(column).asc()], "count", "running")
    total = groups.agg(F.sum("count").alias("total"))
    return ordered.withColumn("before", F.col("running") - F.col("count")).crossJoin(F.broadcast(total))


def pareto_table(df: DataFrame, column: str = "cause") -> DataFrame:
    """Every category with its fraction and strict running fraction; nothing suppressed."""
    ordered = _in_order(group_counts(df, column, min_group=1), column)
    return ordered.select(
        F.col(column).alias("category"),
        "count",
        round_to(F.col("count") / F.col("total"), 6).alias("proportion"),
        round_to(F.col("running") / F.col("total"), 6).alias("cumulative_proportion"),
    ).orderBy(F.desc("count"), "category")


def pareto_core(
    df: DataFrame, column: str = "cause", cut: float = PARETO_CUT, min_group: int = 1
) -> DataFrame:
    """Smallest set of leading categories that reaches the cut, the one crossing it included."""
    ordered = _in_order(group_counts(df, column, min_group=min_group), column)
    running = F.col("running") / F.col("total")
    previous = F.col("before") / F.col("total")
    return (
        ordered.where((previous < cut) | (F.col("before") == 0))
        .select(
            F.col(column).alias("category"),
            "count",
            round_to(F.col("count") / F.col("total"), 4).alias("proportion"),
            round_to(running, 4).alias("cumulative_proportion"),
        )
        .orderBy(F.desc("count"), "category")
    )


def executive_pareto(
    df: DataFrame,
    column: str = "cause",
    cut: float = PARETO_CUT,
    context: int = 3,
    max_items: int = 10,
    min_group: int = MIN_GROUP,
    others: str = "Otras causas",
) -> DataFrame:
    """Core categories plus a few for context, the rest folded into one row that ends at 100 %."""
    ordered = _in_order(group_counts(df, column, min_group=min_group), column)
    core = ordered.agg(
        F.count(F.when(F.col("before") / F.col("total") < cut, F.lit(1))).alias("core_size"),
        F.count(F.lit(1)).alias("groups"),
    )
    # One leading set of at most max_items rows is all that needs a global rank.
    leading = ordered.orderBy(F.desc("count"), column).limit(max_items)
    ranked = leading.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("count"), F.col(column)))
    )
    shown = ranked.crossJoin(F.broadcast(core)).where(  # exactly one row
        F.col("rank") <= F.least(F.col("core_size") + context, F.lit(max_items))
    )
    rows = shown.select(
        F.col("rank").cast("long").alias("position"),
        F.col(column).alias("category"),
        "count",
        round_to(share(F.col("count"), F.col("total")), 2).alias("percentage"),
        round_to(share(F.col("running"), F.col("total")), 2).alias("cumulative_pct"),
        (F.col("rank") <= F.col("core_size")).alias("in_core"),
        F.lit(1).cast("long").alias("grouped"),
    )
    rest = shown.groupBy("groups", "total").agg(
        F.sum("count").alias("displayed"), F.count(F.lit(1)).alias("items")
    ).where(F.col("items") < F.col("groups"))
    tail = rest.select(
        (F.col("items") + 1).alias("position"),
        F.lit(others).alias("category"),
        (F.col("total") - F.col("displayed")).alias("count"),
        round_to(share(F.col("total") - F.col("displayed"), F.col("total")), 2).alias("percentage"),
        F.lit(100.0).alias("cumulative_pct"),
        F.lit(False).alias("in_core"),
        (F.col("groups") - F.col("items")).alias("grouped"),
    )
    return rows.unionByName(tail).orderBy("position")
