"""Structured Streaming jobs over event logs. Each takes a streaming DataFrame and returns one."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from casemill.operators.directory import MAX_PER_MINUTE, WINDOW_SECONDS
from casemill.operators.requests import INITIAL, OUTCOMES, request_runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THROTTLE_OUTPUT = StructType(
    [
        StructField("sender", LongType()),
        StructField("send_id", LongType()),
        StructField("sent_at", DoubleType()),
        StructField("accepted", BooleanType()),
        StructField("outcome", StringType()),
    ]
)
_DELAY, _NEVER_LATE = "spark.watermarkDelayMs", "2200-01-01 00:00:00"
_THROTTLE_STATE = StructType([StructField("accepted", ArrayType(DoubleType()))])
REQUEST_OUTPUT = StructType(
    [
        StructField("request_id", LongType()),
        StructField("attempt_id", LongType()),
        StructField("code", LongType()),
        StructField("reason", StringType()),
        StructField("state", StringType()),
        StructField("version", LongType()),
    ]
)
OUTPUT_ROWS = 100_000
_REQUEST_STATE = StructType([StructField("state", StringType()), StructField("version", LongType())])


def throttle_stream(
    events: DataFrame, limit: int = MAX_PER_MINUTE, seconds: int = WINDOW_SECONDS, lateness: str = "1 minute"
) -> DataFrame:
    """Accept or refuse (sender, send_id, sent_at) as it arrives; only accepted events use the allowance.

    The state of a sender is the accepted times of its trailing window, at most ``limit`` of them, and
    is dropped once event time has moved a window beyond the last one. Sends at or before the watermark
    come too late for it: they are refused with the outcome ``late`` and change nothing, as are sends without
    a time (``no_time``).
    """

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "send_id"])
        # In order of time, so the late ones come first and those without a time last.
        late = int((rows["at"] * 1000 <= state.getCurrentWatermarkMs()).sum())
        timed = int(rows["at"].notna().sum())
        outcome = [False] * late
        for at in rows["at"].iloc[late:timed]:
            accepted = [t for t in accepted if t > at - seconds]
            ok = len(accepted) < limit
            if ok:
                accepted.append(at)
            outcome.append(ok)
        if accepted or late < timed:
            state.update((accepted,))
            newest = max([*accepted[-1:], *rows["at"].iloc[:timed].tail(1)])
            state.setTimeoutTimestamp(max(int((newest + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        said = ["late"] * late + ["sent" if ok else "throttled" for ok in outcome[late:]]
        untimed = len(rows) - timed
        outcome, said = outcome + [False] * untimed, said + ["no_time"] * untimed
        yield pd.DataFrame(
            {
                "sender": key[0], "send_id": rows["send_id"].values, "sent_at": rows["at"].values, "accepted": outcome,
                "outcome": said,
            }
        )

    marked = events.withWatermark("sent_at", lateness)
    # The grouping drops rows whose marked column is behind the watermark. The mark moves to a column that never
    # is, so late sends get here; the watermark itself still follows ``sent_at``.
    mark = json.loads(marked.select("sent_at").schema.json())["fields"][0]["metadata"] or {_DELAY: 0}
    timed = marked.select(
        "sender",
        "send_id",
        (F.unix_micros("sent_at") / 1_000_000.0).alias("at"),
        F.greatest("sent_at", F.lit(_NEVER_LATE).cast("timestamp")).alias("clock", metadata=mark),
    )
    return timed.groupBy("sender").applyInPandasWithState(
        run, THROTTLE_OUTPUT, _THROTTLE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def request_state_stream(attempts: DataFrame) -> DataFrame:
    """Apply transition attempts per request as they arrive; the state is (current state, version).

    Of a request's attempts in a micro-batch a task holds a few numbers each, not their texts, and results leave in
    parts of ``OUTPUT_ROWS``.
    """
    read, judge = request_runs()
    codes, reasons = (np.array(list(x), dtype=kind) for x, kind in zip(zip(*OUTCOMES), ("int64", object)))

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, version = state.get if state.exists else (INITIAL, 1)
        parts = [(rows[["attempted_at", "attempt_id"]], *read(rows)) for rows in batches]
        places, asked, expected = (list(x) for x in zip(*parts))
        placed = pd.concat(places, ignore_index=True).sort_values(["attempted_at", "attempt_id"])
        order = placed.index.to_numpy()
        outcome, changes = judge(now, version, np.concatenate(asked)[order], np.concatenate(expected)[order])
        states, versions = [now, *(c[1] for c in changes)], [version, *(c[2] for c in changes)]
        state.update((states[-1], versions[-1]))
        # After the change itself the new state holds.
        met = np.zeros(len(order), np.int8)
        for at, _, _ in changes:
            met[at:] += 1
        ids, states, versions = placed["attempt_id"].to_numpy(), np.array(states, dtype=object), np.array(versions)
        for begin in range(0, len(order), OUTPUT_ROWS):
            part = slice(begin, begin + OUTPUT_ROWS)
            yield pd.DataFrame(
                {
                    "request_id": key[0], "attempt_id": ids[part], "code": codes[outcome[part]], "reason": reasons[outcome[part]],
                    "state": states[met[part]], "version": versions[met[part]],
                }
            )

    return attempts.groupBy("request_id").applyInPandasWithState(
        run, REQUEST_OUTPUT, _REQUEST_STATE, "append", GroupStateTimeout.NoTimeout
    )


def volume_stream(
    events: DataFrame, time: str = "ts", window: str = "1 day", slide: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Events per tumbling or sliding window of event time; rows later than the watermark are dropped."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        events.withWatermark(time, lateness)
        .groupBy(span.alias("span"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("span.start").alias("period_start"), F.col("span.end").alias("period_end"), "count")
    )


def session_stream(
    events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour"
) -> DataFrame:
    """Events per user session, closed after a gap without events."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.col(user), F.session_window(time, gap).alias("span"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(user, F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "count")
    )


__all__ = ["request_state_stream", "session_stream", "throttle_stream", "volume_stream"]
