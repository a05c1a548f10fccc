"""Event-time signals: windowed counts, duplicates within a watermark, cooldown per key.

Counts, sessions and duplicates work on streams and on tables; `cooldown_of` is the batch twin of
`cooldown`. Defined results: events later than the watermark are dropped by the stream; null is a
key like any other; events at one time are ordered by event_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, every: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, events and value of every window; works on streams and on tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", every, slide or every), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Without repeated fingerprints; the stream forgets a fingerprint behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop and events of every session."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.max("ts").alias("stop"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "stop", "events")


def quiet_gap(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Batch: events at least `seconds` after the event of their key before them."""
    before = F.lag("ts").over(W.partitionBy(*keys).orderBy("ts", "event_id"))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("ts") >= F.col("_before") + F.expr(f"INTERVAL {seconds} SECONDS"))).drop("_before")


def cooldown_of(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Batch: events that come at least `seconds` after the last event of their key that was let through.
    Rows are sorted by key and time in their task and pass one by one; no group is held in memory."""
    picked = events.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id")
    ordered = picked.repartition(*[f"k{n}" for n in range(len(keys))]).sortWithinPartitions(*[f"k{n}" for n in range(len(keys))], "at", "event_id")

    def pass_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            kept = []
            for row, values in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(keys) + 1)))):
                if values[:-1] != key:
                    key, last = values[:-1], None
                if last is None or values[-1] - last >= seconds:
                    kept.append(row)
                    last = values[-1]
            yield batch.select([len(keys) + 1]).take(pa.array(kept, pa.int64()))

    passed = ordered.mapInArrow(pass_through, f"event_id {events.schema['event_id'].dataType.simpleString()}")
    return events.join(passed, "event_id", "left_semi")


def cooldown(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream: events of a (user_id, event_type) that come at least `seconds` after the last one let
    through. The state is one time per key and expires with the cooldown."""

    def pass_through(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for at, event in zip(rows["ts"].astype("int64") // 1000, rows["event_id"]):
            if last is None or at - last >= seconds * 1_000_000:
                kept.append(event)
                last = at
        if last is not None:
            state.update((last,))
            due = last // 1000 + seconds * 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(int(due))
        yield rows[rows["event_id"].isin(kept)][["event_id", "user_id", "event_type", "ts"]]

    timed = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id", "event_type").applyInPandasWithState(
        pass_through, "event_id bigint, user_id bigint, event_type string, ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
