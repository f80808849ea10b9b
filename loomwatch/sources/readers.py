"""Reading raw lines and sensor batches, in batch or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "event_id string, source_type string, source_host string, raw_payload string, received_at timestamp, tags array<string>, risk_score int"


def raw_lines(spark: SparkSession, path: str, source_type: str = "syslog", source_host: str = "unknown", stream: bool = False) -> DataFrame:
    """Text files, one line a raw event; ids from the file and the line's content, time of receipt that of the file."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_modification_time").alias("received_at"))
    return lines.select(
        F.sha2(F.concat_ws("\n", "__file", "value"), 256).alias("event_id"),
        F.lit(source_type).alias("source_type"),
        F.lit(source_host).alias("source_host"),
        F.col("value").alias("raw_payload"),
        "received_at",
        F.array().cast("array<string>").alias("tags"),
        F.lit(0).alias("risk_score"),
    )


def usable_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with source type and host, and those without for quarantine."""
    ok = (F.trim(F.coalesce("source_type", F.lit(""))) != "") & (F.trim(F.coalesce("source_host", F.lit(""))) != "")
    return raw.where(ok), raw.where(~ok)


def decoded(raw: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Binary payloads as text; invalid bytes become replacement characters."""
    return raw.withColumn(payload, F.to_char(F.col(payload), F.lit("utf-8")))


def sensor_batches(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files of one JSON batch a line: batch_id, sent_at, position and payload (text) of each event."""
    reader = spark.readStream if stream else spark.read
    batch = F.try_parse_json("value")
    rows = reader.text(path).select(
        F.try_variant_get(batch, "$.batch_id", "string").alias("batch_id"),
        F.try_variant_get(batch, "$.sent_at", "string").alias("sent_at"),
        F.posexplode(F.try_variant_get(batch, "$.events", "array<variant>")).alias("position", "event"),
    )
    return rows.select("batch_id", "sent_at", "position", F.to_json("event").alias("payload"))


def kafka_lines(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """Raw events of a Kafka topic (needs the connector on the class path); the limit a trigger is the backpressure."""
    source = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": per_trigger})
    return source.load().select(F.col("key").cast("string").alias("source_host"), F.col("value").cast("string").alias("raw_payload"), F.col("timestamp").alias("received_at"))
