"""E-mail directory and send log."""

from __future__ import annotations

import sys
from collections import deque

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from casemill.functions.scan import sequential_scan
from casemill.functions.text import strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Directory states, its largest size, accepted mails per minute.
ACTIVE, INACTIVE, SUSPENDED = "activo", "inactivo", "suspendido"
MAX_ENTRIES = 2_000
MAX_PER_MINUTE = 100
WINDOW_SECONDS = 60


def normal_address(address: Column) -> Column:
    return F.lower(strip(address))


def set_status(directory: DataFrame, emails: DataFrame, status: str) -> DataFrame:
    """Directory with the listed addresses set to a status; ``changed`` marks rows that really changed."""
    listed = emails.select(normal_address(F.col("email")).alias("email")).distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    return directory.join(listed, "email", "left").select(
        *[c for c in directory.columns if c != "status"],
        F.when(hit, F.lit(status)).otherwise(F.col("status")).alias("status"),
        (hit & (F.col("status") != status)).alias("changed"),
    )


def list_by_status(directory: DataFrame, status: str) -> DataFrame:
    return directory.where(F.col("status") == status)


def add_entries(directory: DataFrame, new: DataFrame, cap: int = MAX_ENTRIES) -> DataFrame:
    """Outcome per new address in arrival order: added, exists, or rejected once the directory is full.

    ``new`` holds (email, arrival). The directory never exceeds the cap, so the rows that fit are a
    bounded top-k by arrival.
    """
    arrived = (
        new.select(normal_address(F.col("email")).alias("email"), "arrival")
        .groupBy("email")
        .agg(F.min("arrival").alias("arrival"))
    )
    known = directory.select("email").distinct().withColumn("_known", F.lit(True))
    marked = arrived.join(known, "email", "left")
    fresh = marked.where(F.col("_known").isNull()).select("email", "arrival")
    room = max(cap - directory.count(), 0)
    fitting = fresh.orderBy("arrival", "email").limit(room).select("email", F.lit(True).alias("_fits"))
    outcome = (
        F.when(F.col("_known").isNotNull(), F.lit("exists"))
        .when(F.col("_fits").isNotNull(), F.lit("added"))
        .otherwise(F.lit("directory_full"))
    )
    joined = marked.join(F.broadcast(fitting), "email", "left")  # at most cap rows
    return joined.select("email", "arrival", outcome.alias("outcome"))


def remove_entries(directory: DataFrame, emails: DataFrame) -> DataFrame:
    listed = emails.select(normal_address(F.col("email")).alias("email"))
    return directory.join(listed, "email", "left_anti")


def _throttle(limit: int, seconds: int):
    def start() -> deque:
        return deque()

    def step(accepted: deque, row) -> tuple[bool]:
        while accepted and accepted[0] <= row.scan_at - seconds:
            accepted.popleft()
        ok = len(accepted) < limit
        if ok:
            accepted.append(row.scan_at)
        return (ok,)

    return start, step


def throttled(
    events: DataFrame, key: str, time: str, order: str, limit: int = MAX_PER_MINUTE, seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Add ``accepted``: fewer than ``limit`` accepted events of the key in the trailing window.

    Only busy stretches need the sequential rule. Time is cut into slots as long as the window; an
    event's window lies inside its own slot and the one before, so when those two hold at most
    ``limit`` events everything in the slot is accepted. The other slots, with their predecessors,
    form islands that are apart by at least one quiet slot and are scanned on their own. A hot key is
    therefore many islands, and memory never exceeds ``limit`` times. Events without a time are refused and
    use no allowance.
    """
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000.0
    slotted = events.withColumn("scan_at", at).withColumn("scan_slot", F.floor(F.col("scan_at") / seconds))
    counts = slotted.groupBy(key, "scan_slot").agg(F.count(F.lit(1)).alias("_n"))
    previous = counts.select(key, (F.col("scan_slot") + 1).alias("scan_slot"), F.col("_n").alias("_before"))
    full = counts.join(previous, [key, "scan_slot"], "left").where(
        F.col("_n") + F.coalesce("_before", F.lit(0)) > limit
    )
    busy = full.select(key, F.explode(F.array(F.col("scan_slot") - 1, F.col("scan_slot"))).alias("scan_slot")).distinct()
    by_key = Window.partitionBy(key).orderBy("scan_slot")
    islands = busy.withColumn("scan_island", F.col("scan_slot") - F.row_number().over(by_key))
    marked = slotted.join(islands, [key, "scan_slot"], "left")
    calm = marked.where(F.col("scan_island").isNull()).withColumn("accepted", F.col("scan_at").isNotNull())
    start, step = _throttle(limit, seconds)
    scanned = sequential_scan(
        marked.where(F.col("scan_island").isNotNull()),
        [key, "scan_island"],
        ["scan_at", order],
        start,
        step,
        StructType([StructField("accepted", BooleanType())]),
    )
    return calm.unionByName(scanned).select(*events.columns, "accepted")


def send_outcomes(log: DataFrame, directory: DataFrame, limit: int = MAX_PER_MINUTE) -> DataFrame:
    """Outcome of each send attempt (send_id, sender, recipient, sent_at).

    Unknown and inactive recipients are refused and do not use up the sender's allowance, as are sends without
    a time.
    """
    known = directory.select("email", "status")
    looked_up = log.withColumn("_to", normal_address(F.col("recipient"))).join(
        known, F.col("_to") == F.col("email"), "left"
    )
    allowed = looked_up.where(F.col("status") == ACTIVE).select(*log.columns)
    refusal = F.when(F.col("sent_at").isNull(), F.lit("no_time")).otherwise(F.lit("throttled"))
    outcome = F.when(F.col("accepted"), F.lit("sent")).otherwise(refusal)
    tried = throttled(allowed, "sender", "sent_at", "send_id", limit).select(*log.columns, outcome.alias("outcome"))
    refused = looked_up.where(F.col("status").isNull() | (F.col("status") != ACTIVE)).select(
        *log.columns,
        F.when(F.col("status").isNull(), F.lit("not_in_directory")).otherwise(F.lit("inactive")).alias("outcome"),
    )
    return tried.unionByName(refused)


def busy_upper_bound(log: DataFrame, limit: int = MAX_PER_MINUTE) -> DataFrame:
    """Per sender and minute: attempts beyond the limit, an upper bound of throttled mails in that minute."""
    minute = F.date_trunc("minute", F.col("sent_at").cast("timestamp"))
    counted = log.groupBy("sender", minute.alias("minute")).agg(F.count(F.lit(1)).alias("attempts"))
    return counted.withColumn("beyond_limit", F.greatest(F.col("attempts") - limit, F.lit(0)))
