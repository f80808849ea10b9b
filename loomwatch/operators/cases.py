"""Case work as a log of typed entries, and the projections that consoles show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.functions import severity
from loomwatch.operators.alerts import CASE_STATES, allowed

# Kinds of evidence, of audited actions, labels of states.
EVIDENCE_KINDS = ("event", "alert", "incident", "ioc", "asset", "user", "file", "log", "note")
AUDIT_ACTIONS = ("create", "update", "delete", "transition", "assign", "claim", "comment", "evidence", "task", "attach", "resolve", "close", "reopen")
LABELS = {"open": "Open", "in_progress": "In progress", "on_hold": "On hold", "resolved": "Resolved", "closed": "Closed", "reopened": "Reopened"}


def state(log: DataFrame) -> DataFrame:
    """case_id, status, owner, resolution, closed_at, refused from a log (case_id, ts, kind, value).

    kind: transition, close, resolve, assign, claim and others. Staying is no valid transition of a case; a
    resolution leaves the status; closed_at stays when a case is reopened; a claim counts where nobody owns
    the case. The log of one case is gathered in one row.
    """
    start = F.struct(
        F.lit("open").alias("status"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(0).alias("refused")
    )

    def step(s: Column, e: Column) -> Column:
        moves = e["kind"].isin("transition", "close")
        target = F.when(e["kind"] == "close", F.lit("closed")).otherwise(e["value"])
        ok = moves & allowed(s["status"], target, CASE_STATES, same=False)
        taken = (e["kind"] == "claim") & s["owner"].isNull()
        return F.struct(
            F.when(ok, target).otherwise(s["status"]).alias("status"),
            F.when((e["kind"] == "assign") | taken, e["value"]).otherwise(s["owner"]).alias("owner"),
            F.when(e["kind"] == "resolve", e["value"]).otherwise(s["resolution"]).alias("resolution"),
            F.when(ok & (target == "closed"), e["ts"]).otherwise(s["closed_at"]).alias("closed_at"),
            (s["refused"] + (moves & ~ok).cast("int")).alias("refused"),
        )

    entries = F.array_sort(F.collect_list(F.struct("ts", "kind", "value")))
    return log.groupBy("case_id").agg(F.aggregate(entries, start, step).alias("s")).select("case_id", "s.*")


def evidence(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence (case_id, ts, kind, label) once a label, the first of it; and what is of no known kind."""
    known = F.coalesce(F.col("kind").isin(*EVIDENCE_KINDS), F.lit(False))
    first = entries.where(known).groupBy("case_id", "label").agg(F.min_by("kind", F.struct("ts", "kind")).alias("kind"), F.min("ts").alias("ts"))
    return first, entries.where(~known)


def tasks(log: DataFrame) -> DataFrame:
    """case_id, task_id, title, done from a log (case_id, task_id, ts, action, title): created, completed, reopened."""
    last = F.max_by("action", F.struct("ts", "action"))
    return log.groupBy("case_id", "task_id").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("ts"))).alias("title"), (last == "completed").alias("done"))


def comments(entries: DataFrame, newest_first: bool = True) -> DataFrame:
    """The comments (ts, author, text) of each case in one array."""
    held = F.array_sort(F.collect_list(F.struct("ts", "author", "text")))
    return entries.groupBy("case_id").agg((F.reverse(held) if newest_first else held).alias("comments"))


def owners(log: DataFrame) -> DataFrame:
    """Each transfer of a case: case_id, ts, before, after."""
    before = F.lag("owner").over(Window.partitionBy("case_id").orderBy("ts", "owner"))
    return log.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("owner"))).select("case_id", "ts", "before", F.col("owner").alias("after"))


def alert_list(alerts: DataFrame) -> DataFrame:
    return alerts.select("fingerprint", "title", "rule_id", "severity", "risk", "priority", "status", "occurrences", "first_seen", "last_seen")


def incident_list(incidents: DataFrame) -> DataFrame:
    return incidents.select("fingerprint", "title", "severity", "risk", "priority", "status", F.size("alert_ids").alias("alerts"), F.size("assets").alias("assets"), "first_seen", "last_seen")


def case_list(cases: DataFrame) -> DataFrame:
    """With the numbers of alerts and indicators, and the label of the status."""
    return cases.select("case_id", "title", "severity", "priority", severity.lookup(F.col("status"), LABELS).alias("status"), F.size("alert_ids").alias("alerts"), F.size("iocs").alias("iocs"), F.size("timeline").alias("entries"), "created_at")


def with_counts(cases: DataFrame, **logs: DataFrame) -> DataFrame:
    """Adds <name>_count for each log (comments, evidence, tasks, attachments; case_id), zero where a case has none. Logs are counted in one aggregate."""
    rows = [log.select("case_id", F.lit(name).alias("__log")) for name, log in logs.items()]
    counts = reduce(lambda a, b: a.unionByName(b), rows).groupBy("case_id").agg(*[F.count_if(F.col("__log") == name).alias(f"{name}_count") for name in logs])
    joined = cases.join(counts, "case_id", "left")
    return joined.withColumns({f"{name}_count": F.coalesce(f"{name}_count", F.lit(0).cast("long")) for name in logs})


def incident_of_event(events: DataFrame, prefix: str = "sensor-event:") -> DataFrame:
    """Incidents opened by hand for sensor events (event_id, severity, ts): risk and priority by severity."""
    risk = severity.lookup(severity.known(F.col("severity")), severity.EVENT_RISK)
    return events.select(F.concat(F.lit(prefix), F.col("event_id").cast("string")).alias("incident_id"), severity.known(F.col("severity")).alias("severity"), risk.alias("risk"), severity.priority(risk).alias("priority"), F.col("ts").alias("created_at"))


def open_once(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New cases for incidents that have none; of several new ones for one incident the first."""
    first = Window.partitionBy("incident_id").orderBy("created_at", "case_id")
    return new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").join(existing.select("incident_id").distinct(), "incident_id", "left_anti")


def entity_context(entities: DataFrame, assets: DataFrame, incidents: DataFrame) -> DataFrame:
    """Host names with their inventory row and the number of incidents that name them."""
    named = incidents.select(F.explode(F.array_distinct("assets")).alias("hostname")).groupBy("hostname").agg(F.count("*").alias("incidents"))
    return entities.select("hostname").distinct().join(assets, "hostname", "left").join(named, "hostname", "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))


def console_kpis(alerts: DataFrame) -> DataFrame:
    """Counts by severity and status and the mean risk, half up, as the console rounds."""
    return alerts.agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("status") == "open").alias("open"), F.coalesce(F.floor(F.avg("risk") + 0.5), F.lit(0)).alias("avg_risk")
    )


def rule_summary(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count_if("enabled").alias("enabled"), F.coalesce(F.sum("fire_count"), F.lit(0)).alias("fired"), F.count_if(F.col("severity").isin("critical", "high")).alias("severe"))


def intel_summary(iocs: DataFrame) -> DataFrame:
    return iocs.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count_if(F.col("reputation").isin("malicious", "suspicious")).alias("suspect"), F.count("*").alias("iocs"))


def queue_counters(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("sla_state").isin("overdue", "missed", "warning")).alias("attention"), F.count_if(F.col("owner").isNull()).alias("unassigned")
    )


def duration(seconds: Column) -> Column:
    """2d 3h, 3h 4m or 4m."""
    s = F.floor(F.abs(seconds)).cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(days > 0, F.format_string("%dd %dh", days, hours)).when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))
