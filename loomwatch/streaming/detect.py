"""Stateful streaming twins of the batch operators."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def threshold(events: DataFrame, key: str, threshold_: int, seconds: int, strict: bool = False, ts: str = "ts", order: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """key, event_id, window_count of events at (strict: above) the threshold of their key's window.

    The state of a key is the times within the window, and goes once the watermark has left it behind. Rows of
    one micro-batch are taken in order of time, so a key's part of a micro-batch is in memory; the source's
    limits per trigger bound it. Rows that come in a later batch than newer ones count what the state still holds.
    """
    span = seconds * 1_000_000

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        out, first = [], 0
        for t, i in zip(rows["t"].tolist(), rows["id"].tolist(), strict=True):
            insort(held, t)
            first = bisect_left(held, t - span)
            n = bisect_right(held, t) - first
            if n > threshold_ or (not strict and n == threshold_):
                out.append((k[0], i, n))
            if first > 4096:  # later rows are not older
                del held[:first]
        newest = held[-1]
        state.update((held[bisect_left(held, newest - span) :],))
        state.setTimeoutTimestamp(max((newest + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "window_count"])

    rows = events.where(F.col(key).isNotNull()).withWatermark(ts, delay).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("id"), F.unix_micros(ts).alias("t"), ts)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, event_id long, window_count long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def first_alerts(alerts: DataFrame, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """fingerprint, event_id, occurrence: every alert with its place among those of its fingerprint; the state is a counter."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        state.update((n + len(rows),))
        yield pd.DataFrame({"fingerprint": k[0], "event_id": rows["id"], "occurrence": range(n + 1, n + len(rows) + 1)})

    rows = alerts.select("fingerprint", F.col(order).cast("long").alias("id"), F.unix_micros(ts).alias("t"))
    return rows.groupBy("fingerprint").applyInPandasWithState(run, "fingerprint string, event_id long, occurrence long", "n long", "append", GroupStateTimeout.NoTimeout)


def distinct_events(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row a key; the state of a key goes once the watermark has passed it."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def minute_counts(events: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    w = F.window(ts, "1 minute").alias("w")
    return events.withWatermark(ts, delay).groupBy(w).agg(F.count("*").alias("events")).select(F.col("w.start").alias("minute"), "events")
