"""Append-only tables and the views and upserts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_trail(rows: DataFrame, path: str) -> None:
    """The pipeline's trail: stage, correlation_id, ts and more, by stage and day."""
    rows.withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("stage", "event_date").parquet(path)


def trail(spark: SparkSession, path: str, stage: str | None = None, correlation_id: str | None = None) -> DataFrame:
    """By stage newest first, else by time; both conditions reach the scan."""
    rows = spark.read.parquet(path)
    if stage:
        rows = rows.where(F.col("stage") == stage)
    if correlation_id:
        rows = rows.where(F.col("correlation_id") == correlation_id)
    return rows.orderBy(F.desc("ts") if stage and not correlation_id else F.asc("ts"))


def trail_page(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the trail (event_id, ts), newest first; unlike the lists of entities its limit is as asked."""
    return rows.orderBy(F.desc("ts"), "event_id").offset(max(0, offset)).limit(limit)


def as_record(df: DataFrame) -> DataFrame:
    """One JSON text a row, every value as text."""
    return df.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])).alias("payload"))


def one_by_event(inbox: DataFrame, event_id: str) -> DataFrame:
    """The event's row; an error if instances share the id."""
    found = inbox.where(F.col("event_id") == event_id).withColumn("__n", F.count("*").over(Window.partitionBy("event_id")))
    return found.withColumn("event_id", F.when(F.col("__n") > 1, F.raise_error(F.lit("ambiguous event id")).cast("string")).otherwise(F.col("event_id"))).drop("__n")


def recent(inbox: DataFrame, limit: int = 50) -> DataFrame:
    return inbox.orderBy(F.desc("event_timestamp"), F.desc("received_at"), "event_id").limit(max(1, min(100, limit)))


def upsert_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules of both; the new configuration with the old counters."""
    config = [c for c in new.columns if c not in ("rule_id", "fire_count", "last_fired")]
    n = new.select("rule_id", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in config])
    both = old.join(n, "rule_id", "full_outer")
    return both.select("rule_id", *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in config], F.coalesce("fire_count", F.lit(0)).alias("fire_count"), "last_fired")


def iocs(sightings: DataFrame) -> DataFrame:
    """Per value: hits, first and last seen, the first type and the last reputation of (value, ioc_type, reputation, ts)."""
    return sightings.where("value is not null").groupBy("value").agg(
        F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("ioc_type", F.struct("ts", "ioc_type")).alias("ioc_type"), F.max_by("reputation", F.struct("ts", "reputation")).alias("reputation"),
    )


def assets(registrations: DataFrame) -> DataFrame:
    """The last registration of each host name."""
    columns = [c for c in registrations.columns if c != "hostname"]
    last = registrations.where("hostname is not null").groupBy("hostname").agg(F.max_by(F.struct(*columns), F.struct("ts", "registration_id")).alias("__last"))
    return last.select("hostname", *[F.col(f"__last.{c}").alias(c) for c in columns])


def latest_dead_letters(letters: DataFrame, most: int = 1000) -> DataFrame:
    return letters.orderBy(F.desc("received_at"), "event_id").limit(most)


def audit(entries: DataFrame, entity: str | None = None, action: str | None = None, actor: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    for c, v in (("entity", entity), ("action", action), ("actor", actor)):
        if v:
            entries = entries.where(F.col(c) == v)
    return entries.orderBy(F.desc("ts"), "audit_id").offset(offset).limit(limit)


AUDIT = "audit_id string, ts timestamp, actor string, action string, entity string, entity_id string, detail string"


def append_audit(entries: DataFrame, path: str, batch: str) -> None:
    """Entries, each with an id of its content if it has none, in a folder of the batch, which a retry overwrites. Columns that they lack are null."""
    names = [c.split()[0] for c in AUDIT.split(", ")]
    full = entries.select(*[F.col(c) if c in entries.columns else F.lit(None).cast(c_type).alias(c) for c, c_type in (x.split() for x in AUDIT.split(", "))])
    own = F.sha2(F.to_json(F.struct(*names[1:]), {"ignoreNullFields": "false"}), 256)
    full.withColumn("audit_id", F.coalesce("audit_id", own)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def audit_trail(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{AUDIT}, batch string").parquet(path).drop("batch")


def access_audit(requests: DataFrame) -> DataFrame:
    """Audit rows of the requests that change something: method, path, status, outcome."""
    changing = requests.where(F.upper("method").isin("POST", "PUT", "PATCH", "DELETE"))
    return changing.withColumn("outcome", F.when(F.col("status") < 400, "success").otherwise("failure"))


def without(rows: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(deleted.select(key), key, "left_anti")
