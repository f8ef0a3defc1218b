"""Sources that stopped sending heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEARTBEAT_SECONDS = 2.0  # fixed value
DEFAULT_LEASE_SECONDS = 30.0  # fixed value


def lease_seconds(asked: float = DEFAULT_LEASE_SECONDS) -> float:
    """A lease is never shorter than three heartbeats."""
    return max(asked, 3 * HEARTBEAT_SECONDS)


def silent_sources(beats: DataFrame, now: Column, lease: float = DEFAULT_LEASE_SECONDS) -> DataFrame:
    """Sources of ``beats(source, at)`` whose last beat is at least a lease before ``now``."""
    last = beats.where(F.col("at") <= now).groupBy("source").agg(F.max("at").alias("last_beat"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_beat").cast("timestamp"))) / F.lit(1e6)
    return last.withColumn("silent_seconds", age).where(F.col("silent_seconds") >= lease_seconds(lease))


def watch_sources(beats: DataFrame, lease: float = DEFAULT_LEASE_SECONDS, watermark: str = "10 seconds") -> DataFrame:
    """The same on a stream: one row each time a source falls silent. State per source is one timestamp; the timer runs
    on event time, so a replay gives the same rows."""
    lease_ms = int(lease_seconds(lease) * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "last_beat_ms": [last]})
            return
        newest = max(int(b["at"].max().timestamp() * 1000) for b in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        due = last + lease_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    found = beats.withWatermark("at", watermark).groupBy("source").applyInPandasWithState(
        step, "source string, last_beat_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("source", F.timestamp_millis("last_beat_ms").alias("last_beat"))
