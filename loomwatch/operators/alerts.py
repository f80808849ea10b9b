"""Findings to alerts: building, deduplication by fingerprint, lifecycles as logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.functions import keys, severity

# States that may follow each state.
ALERT_STATES = {"open": ("triage", "false_positive"), "triage": ("investigating", "resolved", "false_positive"), "investigating": ("resolved", "false_positive"), "resolved": ("open",), "false_positive": ("open",)}
INCIDENT_STATES = {"open": ("triage",), "triage": ("investigating",), "investigating": ("contained", "resolved"), "contained": ("resolved", "closed"), "resolved": ("closed", "reopened"), "closed": ("reopened",), "reopened": ("investigating", "triage")}
CASE_STATES = {
    "open": ("in_progress", "resolved", "closed"),
    "in_progress": ("on_hold", "resolved", "closed"),
    "on_hold": ("in_progress", "resolved", "closed"),
    "resolved": ("closed", "reopened"),
    "closed": ("reopened",),
    "reopened": ("in_progress", "on_hold"),
}


def build(findings: DataFrame, title: Column | None = None, identity: dict[str, Column] | None = None) -> DataFrame:
    """One alert a finding: severity, risk (the finding's own if it has one), priority, fingerprint, first timeline entry.

    findings: event_id, ts, rule_id, severity, confidence, risk_score (nullable), ip_src, ip_dst, user, source_host.
    """
    level = severity.known(F.col("severity"))
    risk = F.coalesce(F.col("risk_score").cast("int"), severity.risk(level, F.col("confidence")))
    return findings.withColumns(
        {
            "severity": level,
            "risk": risk,
            "priority": severity.priority(risk),
            "fingerprint": keys.alert_fingerprint(F.col("rule_id"), extra=identity),
            "title": title if title is not None else F.concat(F.lit("Detection: "), "rule_id"),
            "status": F.lit("open"),
            "timeline": F.array(F.struct(F.col("ts").alias("at"), F.lit("created").alias("action"))),
        }
    )


def deduplicate(alerts: DataFrame, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """One alert a fingerprint: all from the first, with occurrences, first_seen, last_seen and event_ids' number."""
    columns = [c for c in alerts.columns if c != "fingerprint"]
    kept = alerts.groupBy("fingerprint").agg(
        F.min(F.struct(F.col(ts).alias("__ts"), F.col(order).alias("__id"))).alias("__at"),
        F.min_by(F.struct(*columns), F.struct(F.col(ts), F.col(order))).alias("__first"),
        F.count("*").alias("occurrences"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
    )
    return kept.select("fingerprint", *[F.col(f"__first.{c}").alias(c) for c in columns], "occurrences", "first_seen", "last_seen")


def occurrence(ts: str = "ts", order: str = "event_id") -> Column:
    """1 for the alert that creates its fingerprint, higher for those that are merged into it."""
    return F.row_number().over(Window.partitionBy("fingerprint").orderBy(ts, order))


def with_fire_counts(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rules with fire_count and last_fired brought up to date."""
    fired = alerts.groupBy("rule_id").agg(F.count("*").alias("__n"), F.max("ts").alias("__at"))
    return rules.join(fired, "rule_id", "left").withColumns({"fire_count": F.col("fire_count") + F.coalesce("__n", F.lit(0)), "last_fired": F.greatest("last_fired", "__at")}).drop("__n", "__at")


def allowed(before: Column, after: Column, states: dict[str, tuple[str, ...]], same: bool = True) -> Column:
    """Whether a state may follow; staying is no transition where ``same``."""
    found = F.lit(False)
    for s, following in states.items():
        found = F.when(before == s, after.isin(*following)).otherwise(found)
    return F.coalesce(found | ((before == after) & F.lit(same)), F.lit(False))


def audited(log: DataFrame, states: dict[str, tuple[str, ...]], key: str = "id", initial: str = "open", same: bool = True) -> DataFrame:
    """The log (key, ts, status) with before and valid: each entry against the entry before it."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy(key).orderBy("ts", "status")), F.lit(initial))
    return log.withColumn("before", before).withColumn("valid", allowed(F.col("before"), F.col("status"), states, same))


#: A power of two of entries that are folded at once: 2 ** PIECE_BITS; bits of an id below the partition's, by monotonically_increasing_id().
PIECE_BITS, ID_BITS = 10, 33


def lifecycle(log: DataFrame, states: dict[str, tuple[str, ...]], key: str = "id", initial: str = "open", terminal: str = "closed", keep_closed: bool = False) -> DataFrame:
    """key, status, transitions, refused, moved_at, closed_at: the log (key, ts, status) applied in order, refused entries leaving the state as it is.

    A piece of a log is a map from each state that it may find to what it leaves, and maps of neighbouring pieces
    compose. The log is dealt by ranges of key and time and cut into pieces of bounded length, which are folded for
    every state, then composed within partitions and at last by key. So no task or row has a busy key's whole log.
    moved_at is the time of the last move, closed_at that of the last move to ``terminal``; it goes with the next move
    unless ``keep_closed``. Staying is no move, statuses that no state knows are refused. Entries without key or time are left out.
    """
    names = sorted({*states, initial, *(s for following in states.values() for s in following)})
    none = F.lit(None).cast("timestamp")

    def found(status: Column) -> Column:
        return F.struct(status.alias("status"), F.lit(0).alias("transitions"), F.lit(0).alias("refused"), none.alias("moved_at"), none.alias("closed_at"))

    def step(held: Column, entry: Column) -> Column:
        ok = allowed(held["status"], entry["status"], states)
        moved = ok & (held["status"] != entry["status"])
        return F.struct(
            F.when(ok, entry["status"]).otherwise(held["status"]).alias("status"), (held["transitions"] + moved.cast("int")).alias("transitions"), (held["refused"] + (~ok).cast("int")).alias("refused"),
            F.when(moved, entry["ts"]).otherwise(held["moved_at"]).alias("moved_at"), F.when(moved & (entry["status"] == terminal), entry["ts"]).otherwise(held["closed_at"]).alias("closed_at"),
        )

    def after(held: Column, piece: Column) -> Column:
        x = F.get(piece["map"], (F.array_position(F.array(*map(F.lit, names)), held["status"]) - 1).cast("int"))
        return F.struct(
            x["status"].alias("status"), (held["transitions"] + x["transitions"]).alias("transitions"), (held["refused"] + x["refused"]).alias("refused"),
            F.coalesce(x["moved_at"], held["moved_at"]).alias("moved_at"), F.coalesce(x["closed_at"], held["closed_at"]).alias("closed_at"),
        )

    def of_each(items: Column, by: Callable[[Column, Column], Column]) -> Column:
        return F.array(*[F.aggregate(items, found(F.lit(s)), by) for s in names])

    usable = log.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts"), F.coalesce("status", F.lit("")).alias("status"))
    dealt = usable.repartitionByRange(key, "ts", "status").sortWithinPartitions(key, "ts", "status").withColumn("__piece", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS))
    pieces = dealt.groupBy(key, "__piece").agg(of_each(F.array_sort(F.collect_list(F.struct("ts", "status"))), step).alias("map"))
    composed = F.array_sort(F.collect_list(F.struct("__piece", "map")))
    parts = pieces.groupBy(key, F.shiftright("__piece", ID_BITS - PIECE_BITS).alias("__part")).agg(of_each(composed, after).alias("map")).withColumnRenamed("__part", "__piece")
    done = parts.groupBy(key).agg(F.aggregate(composed, found(F.lit(initial)), after).alias("s")).select(key, "s.*")
    return done if keep_closed else done.withColumn("closed_at", F.when(F.col("status") == terminal, F.col("closed_at")))


def replayed(log: DataFrame, states: dict[str, tuple[str, ...]], key: str = "id", initial: str = "open") -> DataFrame:
    """key, status, transitions, refused of lifecycle()."""
    return lifecycle(log, states, key, initial).select(key, "status", "transitions", "refused")
