"""Keyed sliding windows over event time. The lower bound belongs to the window; later rows of the same instant don't."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arrival(keys: list[str], ts: str, order: str):
    return Window.partitionBy(*keys).orderBy(ts, order)


def window_count(keys: list[str], ts: str, order: str, seconds: int) -> Column:
    """Events of the key in the last ``seconds`` up to this one in order of arrival."""
    micros = F.unix_micros(ts)
    in_range = F.count("*").over(Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0))
    peers = Window.partitionBy(*keys, ts)
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy(order))
    return in_range - later


def window_ids(keys: list[str], ts: str, order: str, seconds: int) -> Column:
    """Ids in the window, in order of arrival."""
    frame = Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    seen = F.collect_list(F.struct(F.col(ts).alias("t"), F.col(order).alias("id"))).over(frame)
    own = F.struct(F.col(ts).alias("t"), F.col(order).alias("id"))
    return F.transform(F.filter(F.array_sort(seen), lambda x: x <= own), lambda x: x["id"])


def with_window_count(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Adds window_count (see above) without bringing all of a key's rows to one task.

    Time is cut into spans of the window's length. Each row counts in its own span and is there for the next
    one, so a window never needs more than the two, and a busy key is dealt to as many tasks as it has spans.
    """
    span = seconds * 1_000_000
    dealt = events.withColumn("__t", F.unix_micros(ts)).withColumn("__later", F.explode(F.array(F.lit(0), F.lit(1))))
    dealt = dealt.withColumn("__span", F.floor(F.col("__t") / F.lit(span)) + F.col("__later"))
    group = [*keys, "__span"]
    in_range = F.count("*").over(Window.partitionBy(*group).orderBy("__t").rangeBetween(-span, 0))
    peers = Window.partitionBy(*group, "__t")
    after = F.count("*").over(peers) - F.row_number().over(peers.orderBy(order))
    return dealt.withColumn("window_count", in_range - after).where("__later = 0").drop("__t", "__later", "__span")


def over_threshold(events: DataFrame, keys: list[str], threshold: int, seconds: int, strict: bool = False, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Every event at (strict: above) the threshold of its key's window, with window_count. Null keys take no part."""
    for k in keys:
        events = events.where(F.col(k).isNotNull())
    counted = with_window_count(events, keys, seconds, ts, order)
    return counted.where(F.col("window_count") > threshold if strict else F.col("window_count") >= threshold)


def threshold_by_ip(events: DataFrame, threshold: int = 5, seconds: int = 300) -> DataFrame:
    return over_threshold(events.where(F.col("ip_src") != ""), ["ip_src"], threshold, seconds)


def login_failures(events: DataFrame, threshold: int = 5, seconds: int = 300) -> DataFrame:
    failed = events.where((F.col("category") == "auth") & F.col("action").isin("reject", "failed"))
    return over_threshold(failed, ["source_host"], threshold, seconds, strict=True)


def within_span(first: Column, last: Column, seconds: int = 3600) -> Column:
    """For aggregates: the whole group lies within the time."""
    return F.unix_micros(F.max(last)) - F.unix_micros(F.min(first)) <= seconds * 1_000_000


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Session per key with start, end and events."""
    s = F.session_window(ts, gap).alias("s")
    return events.groupBy(*keys, s).agg(F.count("*").alias("events")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


class SlidingLimit:
    """At most ``most`` allowed hits in any window; refused hits don't count."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds, self.held = most, seconds, deque()

    def __call__(self, t: float) -> bool:
        while self.held and self.held[0] <= t - self.seconds:
            self.held.popleft()
        allowed = len(self.held) < self.most
        if allowed:
            self.held.append(t)
        return allowed


class TokenBucket:
    """Tokens refill at ``rate`` a second up to ``burst``; each allowed event takes one."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.tokens, self.last = rate, burst, burst, None

    def __call__(self, t: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + (t - self.last) * self.rate)
        self.last = t
        allowed = self.tokens >= 1
        self.tokens -= allowed
        return allowed


def sliding_limit(events: DataFrame, key: str, most: int, seconds: float, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """key, id, allowed by a SlidingLimit of each key."""
    return _folded(events, key, ts, order, lambda: SlidingLimit(most, seconds))


def token_bucket(events: DataFrame, key: str, rate: float, burst: float, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """key, id, allowed by a TokenBucket of each key."""
    return _folded(events, key, ts, order, lambda: TokenBucket(rate, burst))


def _folded(events: DataFrame, key: str, ts: str, order: str, make: Callable[[], Callable[[float], bool]]) -> DataFrame:
    """Rows in order of key and time go by one after another; only the state of the key at hand is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            allowed = []
            for k, t in zip(batch["key"], batch["t"], strict=True):
                if k != at:
                    at, state = k, make()
                allowed.append(state(t))
            yield batch[["key", "id"]].assign(allowed=allowed)

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("id"), (F.unix_micros(ts) / 1e6).alias("t"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(run, "key string, id long, allowed boolean")


def backpressure(sizes: DataFrame, high: int = 8000, low: int = 2000, ts: str = "ts", size: str = "size") -> DataFrame:
    """Adds paused: from a size at high until one at low, whatever lies between."""
    mark = F.when(F.col(size) >= high, True).when(F.col(size) <= low, False)
    frame = Window.partitionBy("collector").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(frame), F.lit(False)))


def retry_delay(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before an attempt (from 1), without jitter."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))
