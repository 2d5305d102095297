"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated up to ``repeats`` times. A copy's
virtual finish time is the running size of its source up to its end, divided by the target of the source;
the copies of all sources are then taken in order of finish time until the budget is used up.

Running sizes come from bins of the shuffled order and the cut from bins of the finish time, so no source
and no global order passes through one task; the driver sees one bin and one row. One row per source
meets in a task for the targets.

Sizes are words (runs of anything but space and the bytes 9 to 13). Targets: sources in order of code
points, null last, weigh ``weights`` repeating and share ``share`` of all sizes; a source's target stops
at ``repeats`` times its size and the excess goes to the others by weight.

Defined results: a null text has size 0 and is never taken, nor is any other empty document (taken 0); a
null source is a source; rows that are equal throughout are interchangeable; an empty table gives no
rows; other columns are ignored. Whole copies are taken, never parts. Order depends on the data only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from casemill.llm.running import shuffle_key, with_running_sum
from casemill.session import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of (source, size) rows, by filling up to the caps.

    With sources in order of cap over weight, the capped ones come first, so one pass over the sources
    finds the level at which no further source is above its cap.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    capped = (
        sources.withColumn("_place", position)
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * repeats)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    order = Window.orderBy("_ratio", "_place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levelled = (
        capped.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
    )
    # The first source whose cap is not below the level ends the capped ones; its level holds for the rest.
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_place", "_level"))).over(everything)["_level"]
    filled = F.coalesce(F.least(F.col("_cap").cast("double"), level * F.col("_w")), F.col("_cap").cast("double"))
    return levelled.select("source", "source_size", filled.alias("target"))


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row per document."""
    rows = durable(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            shuffle_key(F.col(doc_id)).alias("_key"),
        )
    )
    n = rows.count()
    by_source = durable(targets(rows, weights, share, repeats))
    queued = durable(
        with_running_sum(rows, "source", "_key", "size", "_cum", ("size",), n)
        .join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
    )
    finish = [
        F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("_cum") + e * F.col("source_size")) / F.col("target"))
        for e in range(repeats)
    ]
    moment = lambda at, e: F.struct(
        at.alias("at"), F.col("_key").alias("key"), F.coalesce("source", F.lit("")).alias("source"), "size", F.lit(e).alias("copy")
    )
    copies = queued.select(
        F.explode(F.array(*[F.when(at.isNotNull(), moment(at, e)) for e, at in enumerate(finish)])).alias("m"),
    ).where(F.col("m").isNotNull())
    budget = float(share) * (by_source.agg(F.sum("source_size")).first()[0] or 0)
    bins = max(1, int((repeats * n) ** 0.5))
    binned = copies.withColumn("_bin", F.floor(F.col("m.at") * bins))
    running = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = binned.groupBy("_bin").agg(F.sum("m.size").alias("_s")).withColumn("_upto", F.sum("_s").over(running))
    cut_bin = upto.where(F.col("_upto") > budget).orderBy("_bin").limit(1).first()
    last = F.lit(True)
    if cut_bin is not None:
        inside = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
        first_out = (
            binned.where(F.col("_bin") == cut_bin["_bin"])
            .withColumn("_run", F.sum("m.size").over(inside))
            .where(F.col("_run") + F.lit(cut_bin["_upto"] - cut_bin["_s"]) > budget)
            .orderBy("m").limit(1).first()["m"]
        )
        out = F.struct(
            F.lit(first_out["at"]).alias("at"), F.lit(first_out["key"]).alias("key"), F.lit(first_out["source"]).alias("source"),
            F.lit(first_out["size"]).alias("size"), F.lit(first_out["copy"]).alias("copy"),
        )
        taken = [F.coalesce(moment(at, e) < out, F.lit(False)) & at.isNotNull() for e, at in enumerate(finish)]
    else:
        taken = [at.isNotNull() & last for at in finish]
    n_copies = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
    return queued.withColumn("copies", n_copies).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
