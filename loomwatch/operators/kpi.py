"""Dashboards: counts, mean times, minute series, top lists, the decision queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.functions import severity, sla


def severity_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])


def alert_block(alerts: DataFrame) -> DataFrame:
    """active_alerts (all but resolved), critical_alerts, avg_risk (half to even, 0 without alerts)."""
    return alerts.agg(
        F.count_if(F.col("status") != "resolved").alias("active_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.coalesce(F.bround(F.avg("risk")).cast("int"), F.lit(0)).alias("avg_risk"),
    )


def case_block(cases: DataFrame) -> DataFrame:
    """open_cases, closed_cases and mttr in whole seconds, 0 without closed cases."""
    took = (F.unix_micros("closed_at") - F.unix_micros("created_at")) / F.lit(1e6)
    return cases.agg(
        F.count_if(~F.col("status").isin("closed", "resolved")).alias("open_cases"),
        F.count_if(F.col("closed_at").isNotNull()).alias("closed_cases"),
        F.coalesce(F.avg(took).cast("long"), F.lit(0).cast("long")).alias("mttr"),
    )


def minute_series(events: DataFrame, now: str, minutes: int = 60, ts: str = "ts") -> DataFrame:
    """minute, events for each of the last minutes, zero where there are none."""
    end = F.date_trunc("minute", F.lit(now).cast("timestamp"))
    start = end - F.make_interval(mins=F.lit(minutes - 1))
    spark = events.sparkSession
    every = spark.range(1).select(F.explode(F.sequence(start, end, F.make_interval(mins=F.lit(1)))).alias("minute"))
    counts = events.where(F.col(ts).between(start, F.lit(now).cast("timestamp"))).groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("n"))
    return every.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("events"))


def event_rates(events: DataFrame, now: str, ts: str = "ts") -> DataFrame:
    """total, last_24h and eps: the last five minutes' events a second, two places."""
    at, minute = F.lit(now).cast("timestamp"), F.date_trunc("minute", F.lit(now).cast("timestamp"))
    recent = F.count_if((F.col(ts) >= minute - F.make_interval(mins=F.lit(4))) & (F.col(ts) <= at))
    return events.agg(F.count("*").alias("total"), F.count_if((F.col(ts) >= at - F.make_interval(days=F.lit(1))) & (F.col(ts) <= at)).alias("last_24h"), F.bround(recent / F.lit(300.0), 2).alias("eps"))


def top(df: DataFrame, value: Column, n: int = 10, first: str = "ts") -> DataFrame:
    """value, count of the n most frequent; ties by first appearance, then value."""
    counted = df.select(value.alias("value"), F.col(first).alias("__t")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"), F.min("__t").alias("__t"))
    return counted.orderBy(F.desc("count"), "__t", "value").limit(n).select("value", "count")


def inbox_health(inbox: DataFrame) -> DataFrame:
    waiting = F.col("status") == "pending"
    return inbox.agg(F.count("*").alias("total"), F.count_if(waiting).alias("pending"), F.max("received_at").alias("last_received"), F.min(F.when(waiting, F.col("received_at"))).alias("oldest_pending"))


def worst_health(reports: DataFrame) -> DataFrame:
    """offline before degraded before online; online without reports."""
    place = severity.lookup(F.col("health"), {"online": 0, "degraded": 1, "offline": 2}, 0)
    return reports.agg(F.element_at(F.array(F.lit("online"), F.lit("degraded"), F.lit("offline")), F.coalesce(F.max(place), F.lit(0)) + 1).alias("health"))


def rule_metrics(runs: DataFrame) -> DataFrame:
    """Per rule: executions, detections, failures and mean duration of (rule_id, detected, failed, seconds)."""
    return runs.groupBy("rule_id").agg(
        F.count("*").alias("executions"), F.count_if("detected").alias("detections"), F.count_if("failed").alias("failures"), F.round(F.avg("seconds"), 6).alias("mean_seconds")
    )


def metrics(samples: DataFrame) -> DataFrame:
    """Per name: counters' sum, gauges' last value, timers' mean of (name, kind, ts, value)."""
    return samples.groupBy("name", "kind").agg(
        F.round(F.when(F.col("kind") == "counter", F.sum("value")).when(F.col("kind") == "gauge", F.max_by("value", "ts")).otherwise(F.avg("value")), 6).alias("value")
    )


def band(severity_: Column, sla_state: Column, owner: Column) -> Column:
    """Priority band of the decision queue."""
    return (
        F.when(severity_ == "critical", 0).when(severity_ == "high", 1).when(sla_state.isin("overdue", "missed"), 2).when(sla_state == "warning", 3).when(owner.isNull(), 4).otherwise(5)
    )


def urgency() -> list[Column]:
    return [
        F.col("band"), sla.rank(F.col("sla_state")), F.asc_nulls_last("deadline"), F.desc(severity.rank(F.col("severity"))), F.col("owner").isNotNull(), F.desc("created_at"), F.col("id")
    ]


def banded(items: DataFrame) -> DataFrame:
    return items.withColumn("band", band(F.col("severity"), F.col("sla_state"), F.col("owner")))


def decision_queue(items: DataFrame) -> DataFrame:
    """The items (id, severity, sla_state, deadline, owner, created_at) in order of urgency, with band."""
    return banded(items).orderBy(*urgency())


def placed(items: DataFrame) -> DataFrame:
    """The items with band and place (from 1) in the whole queue.

    Bands, ranks and hours of the deadline follow one another; items are numbered within theirs, and only the
    counts of these, few for any number of items, come to one task.
    """
    hour = F.coalesce(F.floor(F.unix_seconds("deadline") / 3600), F.lit(1 << 60))
    rows = banded(items).withColumns({"__rank": sla.rank(F.col("sla_state")), "__hour": hour})
    keys = ["band", "__rank", "__hour"]
    before = F.sum("count").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*keys).count().withColumn("__before", F.coalesce(before, F.lit(0))).drop("count")
    within = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*urgency())))
    return within.join(offsets, keys).withColumn("place", F.col("__before") + F.col("__n")).drop("__rank", "__hour", "__before", "__n")


def queue_sources(incidents: DataFrame, sensor_events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Incidents and sensor events; alerts only where there are neither."""
    first = incidents.unionByName(sensor_events, allowMissingColumns=True)
    return alerts if first.isEmpty() else first


def component_block(alerts: DataFrame, incidents: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of what the dashboard counts of alerts (status, severity, risk), incidents (status, severity) and cases (status, closed_at), with the hours of the service levels."""
    parts = {"alert": alerts, "incident": incidents, "case": cases}
    columns = {"status": "string", "severity": "string", "risk": "int", "closed_at": "timestamp"}
    rows = [df.select(F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]) for kind, df in parts.items()]
    every = reduce(lambda a, b: a.unionByName(b), rows)
    of = lambda kind, more=F.lit(True): F.count_if((F.col("kind") == kind) & more)
    level, ended = F.col("severity"), F.col("status").isin("closed", "resolved")
    counts = {
        "total_alerts": of("alert"),
        "alerts_open": of("alert", F.col("status") == "open"),
        **{f"alerts_{s}": of("alert", level == s) for s in ("critical", "high", "medium", "low")},
        "total_incidents": of("incident"),
        "incidents_open": of("incident", F.col("status") != "closed"),
        "incidents_critical": of("incident", level == "critical"),
        "total_cases": of("case"),
        "cases_open": of("case", ~ended),
        "cases_closed": of("case", F.col("closed_at").isNotNull()),
        "avg_risk_score": F.coalesce(F.bround(F.avg(F.when(F.col("kind") == "alert", F.col("risk")))).cast("int"), F.lit(0)),
    }
    hours = {f"sla_{s}_hours": F.lit(sla.HOURS[s]) for s in ("critical", "high", "medium", "low")}
    return every.agg(*[v.alias(k) for k, v in counts.items()]).withColumns(hours)


def detection_stats(alerts: DataFrame, rules: DataFrame, assets: DataFrame, events: DataFrame, now: str, n: int = 10) -> DataFrame:
    """section, value, count: alerts_by_rule, the n most frequent of top_rules, top_mitre and top_iocs (ties by value), rules_total,
    rules_enabled, critical_assets (1 each) and trend, the events of each of the last sixty minutes.

    alerts: rule_id, mitre, ioc_ids; rules: enabled; assets: hostname, criticality. Alerts are read once.
    """
    pair = lambda section, value: F.struct(F.lit(section).alias("section"), value.alias("value"))
    many = lambda section, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: pair(section, v))
    named = alerts.select(F.explode(F.concat(F.array(pair("top_rules", F.col("rule_id"))), many("top_mitre", F.col("mitre")), many("top_iocs", F.col("ioc_ids")))).alias("p"))
    counted = named.select("p.*").groupBy("section", "value").agg(F.count("*").alias("count"))
    first = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), "value"))
    tops = counted.withColumn("__n", first).where(F.col("__n") <= n).drop("__n")
    by_rule = counted.where("section = 'top_rules'").withColumn("section", F.lit("alerts_by_rule"))
    totals = rules.agg(F.count("*").alias("rules_total"), F.count_if("enabled").alias("rules_enabled")).unpivot([], ["rules_total", "rules_enabled"], "section", "count")
    none = F.lit(None).cast("string")
    critical = assets.where("criticality = 'critical'").select(F.lit("critical_assets").alias("section"), F.col("hostname").alias("value"), F.lit(1).cast("long").alias("count"))
    trend = minute_series(events, now).select(F.lit("trend").alias("section"), F.date_format("minute", "HH:mm").alias("value"), F.col("events").cast("long").alias("count"))
    return reduce(lambda a, b: a.unionByName(b), [tops, by_rule, totals.select("section", none.alias("value"), "count"), critical, trend])


def console_metrics(block: DataFrame, series: DataFrame) -> DataFrame:
    """mttr of the block (seconds) in minutes, half up, and the events of the last minute of the series, which the console calls its last hour."""
    rows = block.select(F.floor(F.col("mttr") / 60 + 0.5).alias("mttr_minutes"), F.lit(None).cast("timestamp").alias("minute"), F.lit(None).cast("long").alias("events"))
    every = rows.unionByName(series.select(F.lit(None).cast("long").alias("mttr_minutes"), "minute", F.col("events").cast("long").alias("events")))
    return every.agg(F.max("mttr_minutes").alias("mttr_minutes"), F.coalesce(F.max_by("events", "minute"), F.lit(0).cast("long")).alias("events_last_hour"))


def incident_metrics(changes: DataFrame) -> DataFrame:
    """key, created, deduplicated, reopened, failures, alerts and avg_alerts (of those created) of changes (key, change, alerts), and the same in all as key null."""
    of = lambda change: F.count_if(F.col("change") == change).alias(change if change != "failed" else "failures")
    grouped = F.coalesce(F.sum(F.when(F.col("change") == "created", F.col("alerts"))), F.lit(0).cast("long")).alias("alerts")
    sums = changes.select(F.coalesce("key", F.lit("")).alias("key"), "change", "alerts").rollup("key").agg(*[of(c) for c in ("created", "deduplicated", "reopened", "failed")], grouped)
    return sums.withColumn("avg_alerts", F.when(F.col("created") > 0, F.col("alerts") / F.col("created")).otherwise(0.0))
