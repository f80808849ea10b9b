"""Alerts to incidents: grouping by criteria, rollup, deduplication; incidents to cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions import keys, severity
from loomwatch.functions.keys import filled
from loomwatch.operators.windows import within_span

# Weight of each criterion, least score, least number of alerts.
WEIGHTS = {"asset": 20, "user": 20, "ioc": 25, "rule": 20, "fingerprint": 30, "time_window": 10, "mitre": 20}
MIN_SCORE, MIN_ALERTS = 40, 2


def one_value(c: str, null_counts: bool = False) -> Column:
    """For aggregates: exactly one distinct value, nulls and empty ones left out unless they count."""
    if null_counts:
        return F.count_distinct(F.coalesce(F.col(c), F.lit("\0"))) == 1
    return F.count_distinct(filled(F.col(c))) == 1


def criteria(seconds: int = 3600) -> dict[str, Column]:
    """For aggregates: which criteria the group meets."""
    has = lambda c: F.coalesce(F.max(F.size(c) > 0), F.lit(False))
    return {
        "asset": one_value("asset_id"),
        "user": one_value("user"),
        "ioc": has("ioc_ids"),
        "rule": one_value("rule_id", True),
        "fingerprint": one_value("fingerprint", True),
        "time_window": within_span(F.col("first_seen"), F.col("last_seen"), seconds),
        "mitre": has("mitre"),
    }


def score(matched: dict[str, Column]) -> Column:
    total = sum((F.when(c, WEIGHTS[k]).otherwise(0) for k, c in matched.items()), F.lit(0))
    return F.bround(total * F.lit(100.0) / F.lit(float(sum(WEIGHTS.values())))).cast("int")


def union_of(c: str) -> Column:
    """For aggregates: the sorted distinct non-empty members of an array column."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(c)), lambda x: x.isNotNull() & (x != ""))))


def values_of(c: str) -> Column:
    return F.array_sort(F.collect_set(filled(F.col(c))))


def group(alerts: DataFrame, by: list[str], seconds: int = 3600) -> DataFrame:
    """Incidents of the groups that have enough alerts and score; the group's alerts are rolled up.

    alerts: by, alert_id, title, rule_id, asset_id, user, severity, risk, confidence, ioc_ids, mitre, fingerprint, first_seen, last_seen.
    Severity is the highest, risk the mean rounded half to even; sets are united.
    """
    matched = criteria(seconds)
    rolled = alerts.groupBy(*by).agg(
        F.count("*").alias("alerts"),
        score(matched).alias("score"),
        F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in matched.items()])).alias("criteria"),
        severity.by_rank(F.max(severity.rank(F.col("severity")))).alias("severity"),
        F.bround(F.avg("risk")).cast("int").alias("risk"),
        F.bround(F.avg("confidence"), 3).alias("confidence"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        values_of("rule_id").alias("rules"),
        values_of("asset_id").alias("assets"),
        values_of("user").alias("users"),
        union_of("ioc_ids").alias("iocs"),
        union_of("mitre").alias("mitre"),
        F.array_sort(F.collect_set("alert_id")).alias("alert_ids"),
    )
    kept = rolled.where((F.col("alerts") >= MIN_ALERTS) & (F.col("score") >= MIN_SCORE))
    title = F.when(F.size("rules") == 1, F.concat(F.lit("Incident: "), F.get("rules", F.lit(0)))).otherwise(F.format_string("Incident with %d alerts", "alerts"))
    key = keys.incident_fingerprint({c: F.col(c) for c in by})
    return kept.withColumns({"title": title, "priority": severity.priority(F.col("risk")), "fingerprint": key, "status": F.lit("open"), "description": description()})


def description() -> Column:
    return F.format_string("%d alerts, rules: %s, score %d", F.col("alerts"), F.array_join("rules", ", "), F.col("score"))


def to_cases(incidents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One case an incident; incidents that have one already (existing: incident_id) get none."""
    made = incidents.dropDuplicates(["fingerprint"]).select(
        F.concat(F.lit("case-"), "fingerprint").alias("case_id"),
        F.col("fingerprint").alias("incident_id"),
        "title", "severity", "priority", "risk", "assets", "users", "iocs", "mitre", "alert_ids",
        F.lit("open").alias("status"),
        F.col("last_seen").alias("created_at"),
        F.array(F.struct(F.col("last_seen").alias("at"), F.lit("created").alias("action"))).alias("timeline"),
    )
    return made if existing is None else made.join(existing.select("incident_id"), "incident_id", "left_anti")


def claims(log: DataFrame) -> DataFrame:
    """case_id, owner: the first claim wins."""
    return log.where("owner is not null").groupBy("case_id").agg(F.min_by("owner", F.struct("ts", "owner")).alias("owner"), F.min("ts").alias("claimed_at"))


def timeline(entries: DataFrame, key: str = "case_id") -> DataFrame:
    """The entries (ts, kind, actor, detail) of each case in one sorted array."""
    return entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "kind", "actor", "detail"))).alias("timeline"))
