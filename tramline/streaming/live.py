"""Structured Streaming twins of the live operators.

A snapshot replaces the one before if its content differs; late, future and repeated records go to a rejected
output with their reason. A trip's rolling history is keyed state with a time to live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramline.sources import sinks

FRESH_SECONDS, FUTURE_SECONDS = 180, 60
RETENTION_SECONDS, MAX_POINTS = 1800, 180


def accepted(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records by their event time against the time they are processed: (accepted, rejected with a reason)."""
    age = F.unix_timestamp("received") - F.unix_timestamp("event_ts")
    reason = F.when(F.col("event_ts").isNull(), "no_timestamp").when(age > FRESH_SECONDS, "stale").when(age < -FUTURE_SECONDS, "future")
    rows = records.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def latest_by_trip(records: DataFrame, delay: str = "180 seconds") -> DataFrame:
    """The newest record of every trip and minute; the watermark bounds the state."""
    return (
        records.withWatermark("event_ts", delay)
        .groupBy("trip_id", F.window("event_ts", "1 minute"))
        .agg(F.max_by(F.struct("delay", "stop_id"), "event_ts").alias("last"), F.max("event_ts").alias("event_ts"))
        .select("trip_id", "event_ts", "last.delay", "last.stop_id")
    )


HISTORY = "trip_id string, points int, first_ts long, last_ts long, last_delay int"
HISTORY_STATE = "ts array<long>, delay array<int>"


def _history(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    times, delays = (list(x) for x in state.get) if state.exists else ([], [])
    known = set(times)
    for frame in frames:
        for ts, delay in zip(frame["ts"].tolist(), frame["delay"].tolist(), strict=True):
            if ts not in known:
                known.add(ts)
                times.append(int(ts))
                delays.append(int(delay))
    order = sorted(range(len(times)), key=times.__getitem__)
    kept = [i for i in order if times[i] >= times[order[-1]] - RETENTION_SECONDS][-MAX_POINTS:]
    times, delays = [times[i] for i in kept], [delays[i] for i in kept]
    state.update((times, delays))
    state.setTimeoutDuration(RETENTION_SECONDS * 1000)
    yield pd.DataFrame({"trip_id": [key[0]], "points": [len(times)], "first_ts": [times[0]], "last_ts": [times[-1]], "last_delay": [delays[-1]]})


def rolling_history(records: DataFrame) -> DataFrame:
    """OP10: of every trip the points of the last half hour, 180 at most. records: trip_id, ts (seconds), delay."""
    return records.groupBy("trip_id").applyInPandasWithState(_history, HISTORY, HISTORY_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def publish_generations(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a snapshot is written as a new generation only if its content differs from the last one's."""
    last: dict[str, object] = {}

    def publish(batch: DataFrame, number: int) -> None:
        sign = batch.agg(F.count("*"), F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)"))).first()
        if tuple(sign) != last.get("sign"):
            write(batch, number)
            last["sign"] = tuple(sign)

    return publish


def publish_to(at: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the same in a folder, whose manifest remembers the last generation; so a query that starts again doesn't publish it twice."""

    def publish(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            sinks.publish(batch, at)

    return publish
