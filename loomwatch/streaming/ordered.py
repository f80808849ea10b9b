"""Stateful operators that see each key's rows in order of event time, whatever order and micro-batch they come in.

Rows wait in a map state by minute until a timer says that the watermark has passed them. So of a key no more than
an Arrow batch and a minute's rows are in memory, the rest lies in the state store, and what has a time of its own
(an incident that falls quiet, a window that closes) ends by event time, not by arrival. Rows behind the watermark
are dropped, rows it has not reached wait for the next run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from loomwatch.functions import severity
from loomwatch.operators import incidents

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that these operators need; the caller's settings stay."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


class Held:
    """A value state that is read once and written once while a key's rows are folded, however many they are."""

    def __init__(self, state):
        self.state, self.value, self.changed = state, None, False

    def load(self) -> None:
        self.value, self.changed = self.state.get() if self.state.exists() else None, False

    def store(self) -> None:
        if self.changed and self.value is not None:
            self.state.update(self.value)
        elif self.changed and self.state.exists():
            self.state.clear()
        self.changed = False

    def update(self, value: tuple) -> None:
        self.value, self.changed = value, True

    def clear(self) -> None:
        self.value, self.changed = None, True


class InOrder(StatefulProcessor):
    """Calls row() for a key's rows in order of time up to the watermark, and due() for what it has waiting before each."""

    #: Columns that rows have here, time in microseconds and id first; output columns, in the order of the tuples that row() and due() yield.
    fields: tuple[str, ...]
    schema: str
    #: Milliseconds of rows that wait under one key of the map.
    BUCKET = 60_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows string")
        self.setup(handle)

    def setup(self, handle) -> None:
        """Sets folded, what the key has besides rows that wait."""
        raise NotImplementedError

    def row(self, key: tuple, at: int, row: list) -> Iterator[tuple]:
        raise NotImplementedError

    def next_due(self) -> int | None:
        """When the key has something to do without a row, in milliseconds."""
        raise NotImplementedError

    def due(self, key: tuple, at: int) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for batch in rows:
            held: dict[int, list] = {}
            for r in batch[list(self.fields)].itertuples(index=False, name=None):
                held.setdefault(int(r[0]) // 1000 // self.BUCKET, []).append([None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r])
            for b, new in held.items():
                before = json.loads(self.waiting.getValue((b,))[0]) if self.waiting.containsKey((b,)) else []
                self.waiting.updateValue((b,), (json.dumps(before + new),))
            self.handle.registerTimer(int(batch["t"].min()) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now, out = timerValues.getCurrentWatermarkInMs(), []
        ahead = []
        self.folded.load()
        for b in sorted(b for (b,) in self.waiting.keys()):
            if b * self.BUCKET > now:
                ahead.append(b * self.BUCKET)
                break
            rows = json.loads(self.waiting.getValue((b,))[0])
            later = [r for r in rows if r[0] // 1000 > now]
            if later:
                self.waiting.updateValue((b,), (json.dumps(later),))
                ahead.append(min(r[0] // 1000 for r in later))
            else:
                self.waiting.removeKey((b,))
            for r in sorted((r for r in rows if r[0] // 1000 <= now), key=lambda r: (r[0], r[1])):
                out += self.overdue(key, r[0] // 1000)
                out += self.row(key, r[0] // 1000, r)
            if len(out) > 10_000:
                yield self.frame(out)
                out = []
        out += self.overdue(key, now)
        self.folded.store()
        if (due := self.next_due()) is not None:
            ahead.append(due)
        if ahead:
            self.handle.registerTimer(min(ahead))
        if out:
            yield self.frame(out)

    def overdue(self, key: tuple, now: int) -> Iterator[tuple]:
        while (due := self.next_due()) is not None and due <= now:
            yield from self.due(key, due)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")])

    def close(self) -> None:
        pass


class IncidentState(InOrder):
    """Alerts of a key into incidents: no_group, new, dedup, and ended once the key has been quiet.

    The group's criteria are kept as running values, so a key's state has one size however many alerts it has. What an
    incident has when it opens stays; later alerts count as occurrences and move last_seen.
    """

    fields = ("t", "id", "user", "asset_id", "rule_id", "fingerprint", "ioc", "mitre", "rank", "risk")
    schema = "key string, event_id long, decision string, told_at long, occurrences long, first_seen long, last_seen long, severity string, risk int, score int"
    #: For each value criterion the first value and whether all were that.
    STATE = "n long, first long, last long, user string, one_user boolean, asset string, one_asset boolean, rule string, one_rule boolean, print string, one_print boolean, ioc boolean, mitre boolean, rank int, risk double, opened boolean, score int, occurrences long, deadline long"
    NAMES = [c.split()[0] for c in STATE.split(", ")]

    def __init__(self, quiet_seconds: int, window_seconds: int = 3600):
        self.quiet, self.window = quiet_seconds * 1000, window_seconds * 1_000_000

    def setup(self, handle) -> None:
        self.folded = Held(handle.getValueState("group", self.STATE))

    def held(self) -> dict | None:
        return None if self.folded.value is None else dict(zip(self.NAMES, self.folded.value, strict=True))

    def next_due(self):
        held = self.held()
        return held and held["deadline"]

    def due(self, key, at):
        held = self.held()
        self.folded.clear()
        if held["opened"]:
            yield self.told(key, None, "ended", at * 1000, held)

    def row(self, key, at, row):
        t, of, user, asset, rule, print_, ioc, mitre, rank, risk = row
        g = self.held()
        values = {"user": user, "asset": asset, "rule": rule, "print": print_}
        if g is None:
            g = {"n": 0, "first": t, "last": t, "ioc": False, "mitre": False, "rank": 0, "risk": 0.0, "opened": False, "score": 0, "occurrences": 0}
            for c, v in values.items():
                g |= {c: v, f"one_{c}": bool(v)}
        g["last"], g["deadline"] = t, at + self.quiet
        if g["opened"]:
            g["occurrences"] += 1
            decision = "dedup"
        else:
            for c, v in values.items():
                if v and not g[c]:  # values that are missing don't tell users or assets apart
                    g |= {c: v, f"one_{c}": True}
                elif v and v != g[c]:
                    g[f"one_{c}"] = False
            g |= {"n": g["n"] + 1, "ioc": g["ioc"] or ioc, "mitre": g["mitre"] or mitre, "rank": max(g["rank"], rank), "risk": g["risk"] + risk}
            met = {"asset": g["one_asset"], "user": g["one_user"], "ioc": g["ioc"], "rule": g["one_rule"], "fingerprint": g["one_print"], "time_window": t - g["first"] <= self.window, "mitre": g["mitre"]}
            g["score"] = round(100 * sum(incidents.WEIGHTS[c] for c, ok in met.items() if ok) / sum(incidents.WEIGHTS.values()))
            g["opened"] = g["n"] >= incidents.MIN_ALERTS and g["score"] >= incidents.MIN_SCORE
            g["occurrences"] = int(g["opened"])
            decision = "new" if g["opened"] else "no_group"
        self.folded.update(tuple(g[c] for c in self.NAMES))
        yield self.told(key, of, decision, t, g)

    def told(self, key, of, decision, at, g):
        return key[0], of, decision, at, g["occurrences"], g["first"], g["last"], severity.SEVERITIES[g["rank"]], round(g["risk"] / g["n"]), g["score"]


class ThresholdDecisions(InOrder):
    """match, no_match or deferred for each event of a key: deferred while its window can still fill.

    An event at which the window that ends with it holds ``least`` is a match. Any other is deferred, and told again
    at the end of its own window: match if an event until then was one, else no_match.
    """

    fields = ("t", "id")
    schema = "key string, event_id long, decision string, told_at long, window_count long"

    def __init__(self, least: int, seconds: int):
        self.least, self.span = least, seconds * 1000

    def setup(self, handle) -> None:
        #: Times within the window, the deferred events in order, the time of the last match.
        self.folded = Held(handle.getValueState("window", "times array<long>, open string, matched long"))

    def held(self) -> tuple[list[int], list, int]:
        times, waiting, matched = self.folded.value or ([], "[]", -1)
        return list(times), json.loads(waiting), matched

    def next_due(self):
        _, waiting, _ = self.held()
        return waiting[0][0] + self.span + 1 if waiting else None  # an event at the very end of the window has been counted

    def due(self, key, at):
        times, waiting, matched = self.held()
        begun, of = waiting.pop(0)
        times = [t for t in times if t >= at - self.span]
        if times or waiting:
            self.folded.update((times, json.dumps(waiting), matched))
        else:
            self.folded.clear()
        yield key[0], of, "match" if matched >= begun else "no_match", (at - 1) * 1000, None

    def row(self, key, at, row):
        t, of = row
        times, waiting, matched = self.held()
        times = [*(x for x in times if x >= at - self.span), at]
        match = len(times) >= self.least
        if match:
            decision, matched = "match", at
        else:
            decision, waiting = "deferred", [*waiting, [at, of]]
        self.folded.update((times, json.dumps(waiting), matched))
        yield key[0], of, decision, t, len(times)


def incident_changes(alerts: DataFrame, key: str, quiet_seconds: int, ts: str = "ts", order: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """What each alert of a stream does to the incident of its key (see IncidentState); rows without key take no part.

    alerts: key, ts, event_id, user, asset_id, rule_id, fingerprint, ioc_ids, mitre, severity, risk.
    """
    rows = alerts.where(F.col(key).isNotNull()).withWatermark(ts, delay).select(
        F.unix_micros(ts).alias("t"), F.col(order).cast("long").alias("id"), "user", "asset_id", "rule_id", "fingerprint",
        F.coalesce(F.size("ioc_ids") > 0, F.lit(False)).alias("ioc"), F.coalesce(F.size("mitre") > 0, F.lit(False)).alias("mitre"), severity.rank(F.col("severity")).alias("rank"), F.col("risk").cast("double").alias("risk"), F.col(key).cast("string").alias("key"), ts,
    )
    return _folded(rows, IncidentState(quiet_seconds), ts)


def threshold_decisions(events: DataFrame, key: str, least: int, seconds: int, ts: str = "ts", order: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """What a rule of ``least`` events of a key in ``seconds`` says of each event of a stream (see ThresholdDecisions); rows without key take no part."""
    rows = events.where(F.col(key).isNotNull()).withWatermark(ts, delay).select(F.unix_micros(ts).alias("t"), F.col(order).cast("long").alias("id"), F.col(key).cast("string").alias("key"), ts)
    return _folded(rows, ThresholdDecisions(least, seconds), ts)


def _folded(rows: DataFrame, processor: InOrder, ts: str) -> DataFrame:
    told = rows.groupBy("key").transformWithStateInPandas(processor, processor.schema, "Append", "EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("told_at", "first_seen", "last_seen") if c in told.columns})
