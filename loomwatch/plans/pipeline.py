"""From raw lines or events to alerts, incidents and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.operators import alerts, incidents, normalize, rules, syslog, windows

COLUMNS = ["event_id", "ts", "ip_src", "ip_dst", "user", "source_host"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as canonical events."""
    kind, user = F.col("event_type"), F.col("user_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.concat(F.lit("host-"), user.cast("string")).alias("source_host"),
        F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), F.pmod(user, F.lit(256)).cast("string")).alias("ip_src"),
        F.lit(None).cast("string").alias("ip_dst"),
        F.concat(F.lit("user-"), user.cast("string")).alias("user"),
        F.when(kind.isin("error", "signup"), "auth").when(kind == "purchase", "network").when(kind == "click", "system").otherwise("process").alias("category"),
        F.when(kind.isin("error", "purchase"), "reject").when(kind == "signup", "accept").when(kind == "click", "info").otherwise("start").alias("action"),
        F.when(F.col("value") < 5, 0.4).otherwise(1.0).alias("confidence"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw lines: two in five RFC 5424, two RFC 3164, one neither."""
    e = events(spark, sf_dir)
    word = F.when(F.col("action") == "reject", "Failed password for").when(F.col("action") == "accept", "Accepted login of").when(F.col("action") == "start", "Started job of").otherwise("Seen")
    message = F.concat_ws(" ", word, "user")
    pri = F.pmod(F.col("event_id"), F.lit(192))
    process = F.element_at(F.array(F.lit("sshd"), F.lit("kernel"), F.lit("init"), F.lit("app")), (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int"))
    new = F.concat(F.lit("<"), pri.cast("string"), F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), "source_host", F.lit(" "), process, F.lit(" - - - "), message)
    old = F.concat(F.lit("<"), pri.cast("string"), F.lit(">Jan  2 03:04:05 "), "source_host", F.lit(" "), process, F.lit("["), F.col("user_id").cast("string"), F.lit("]: "), message)
    form = F.pmod(F.col("event_id"), F.lit(5))
    return e.select("event_id", F.when(form < 2, new).when(form < 4, old).otherwise(message).alias("raw_payload"), F.col("ts").alias("received_at"))


def registry(threshold: int = 3, hours: int = 72) -> rules.Registry:
    held = rules.Registry()
    held.register(rules.Rule("login-failures", lambda e: windows.login_failures(e, threshold, hours * 3600), "high", required=("source_host",), categories=("auth",), tags=("T1110",), priority=50))
    held.register(rules.Rule("large-reject", (F.col("action") == "reject") & (F.col("value") > 200), "critical", required=("ip_src",), categories=("network",), tags=("T1499",), depends_on=("login-failures",)))
    held.register(rules.Rule("busy-source", lambda e: windows.threshold_by_ip(e, 8, 24 * 3600), "medium", required=("ip_src",), tags=("T1046",), priority=10))
    return held


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.findings(events(spark, sf_dir), registry().ordered(), [*COLUMNS, "value", "user_id"])
    confidence = F.when(F.col("value") < 5, 0.4).otherwise(1.0)
    return found.withColumn("confidence", confidence)


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert a finding."""
    return alerts.build(findings(spark, sf_dir))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.deduplicate(alert_rows(spark, sf_dir))


def grouping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the columns that grouping needs; every tenth user is a known indicator."""
    a = deduplicated(spark, sf_dir)
    return a.select(
        F.col("fingerprint").alias("alert_id"), "title", "rule_id", F.col("source_host").alias("asset_id"), "user", "severity", "risk", "confidence",
        F.when(F.pmod(F.col("user_id"), F.lit(10)) == 0, F.array("ip_src")).otherwise(F.array().cast("array<string>")).alias("ioc_ids"),
        F.col("tags").alias("mitre"), "fingerprint", "first_seen", "last_seen", "user_id", "status", "priority", "occurrences",
    )


def incident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.group(grouping_rows(spark, sf_dir), ["asset_id"])


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.to_cases(incident_rows(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syslog.parse(lines(spark, sf_dir))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events through the normalizer of their source type."""
    e = events(spark, sf_dir)
    fields = F.create_map(
        F.lit("src_ip"), F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("ip_src")).otherwise(""), F.lit("source_ip"), F.concat(F.lit("192.168.0."), F.pmod(F.col("user_id"), F.lit(250)).cast("string")),
        F.lit("user"), F.col("user"), F.lit("target_user_name"), F.upper("user"), F.lit("process_name"), F.lit("svc.exe"), F.lit("process"), F.lit("svc"),
    )
    kind = F.element_at(F.array(F.lit("syslog"), F.lit("windows"), F.lit("other")), (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int"))
    return normalize.normalize(e.select("event_id", "ts", "category", "action", "confidence", "source_host", fields.alias("fields"), kind.alias("source_type")))
