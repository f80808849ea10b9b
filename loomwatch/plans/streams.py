"""Streams over the driver's tables, run to their end into tables of the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.operators import alerts
from loomwatch.plans import pipeline
from loomwatch.sources import collector
from loomwatch.streaming import detect, ingest, ordered

#: Bytes of a row group of files that a stream reads.
ROW_GROUP = 1 << 20
#: Files that batches are dealt to, each written by a task of its own, and those of a micro-batch.
FILES, AT_ONCE = 64, 32


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one only where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="loomwatch-")
    return f"{shared.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of canonical events."""

    class Reader:
        """What pipeline.events() reads, as a stream."""

        class read:  # noqa: N801
            @staticmethod
            def parquet(path: str) -> DataFrame:
                directory, _, name = path.rpartition("/")
                return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(directory)

    return pipeline.events(Reader, sf_dir)


def run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that the stream yields, through a sink that writes each micro-batch once."""
    out = folder(spark, name)
    writer = stream.writeStream.foreachBatch(ingest.write_once(f"{out}/rows")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = source(spark, sf_dir).where((F.col("category") == "auth") & (F.col("action") == "reject"))
    return run(spark, detect.threshold(failed, "source_host", 3, 72 * 3600, strict=True), "threshold")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = source(spark, sf_dir).where((F.col("category") == "network") & (F.col("value") > 200))
    findings = hits.withColumns({"rule_id": F.lit("large-reject"), "severity": F.lit("critical"), "risk_score": F.lit(None).cast("int")})
    return run(spark, detect.first_alerts(alerts.build(findings)), "dedup")


def stateless_alerts(events: DataFrame) -> DataFrame:
    """Alerts of the rules that need no window, with what grouping looks at; every tenth user is a known indicator."""
    large = (F.col("category") == "network") & (F.col("value") > 200)
    refused = (F.col("category") == "auth") & (F.col("action") == "reject")
    rule = F.when(large, "large-reject").when(refused, "auth-reject")
    found = events.where(large | refused).withColumns({"rule_id": rule, "severity": F.when(large, "critical").otherwise("high"), "risk_score": F.lit(None).cast("int")})
    return alerts.build(found).select(
        "event_id", "ts", "user", F.col("source_host").alias("asset_id"), "rule_id", "fingerprint", "severity", "risk",
        F.when(F.pmod("user_id", F.lit(10)) == 0, F.array("ip_src")).otherwise(F.array().cast("array<string>")).alias("ioc_ids"), F.array(F.lit("T1499")).alias("mitre"),
    )


def incident_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ordered.session(spark)
    return run(spark, ordered.incident_changes(stateless_alerts(source(own, sf_dir)), "asset_id", 72 * 3600), "incidents")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused = source(ordered.session(spark), sf_dir).where((F.col("category") == "auth") & (F.col("action") == "reject"))
    return run(spark, ordered.threshold_decisions(refused, "source_host", 3, 48 * 3600), "decisions")


def ingested(spark: SparkSession, envelopes: DataFrame, payload: Column | str = "payload") -> DataFrame:
    """The responses to batches (turn, file below FILES, and what payload is made of) that come in micro-batches of AT_ONCE files.

    The narrow rows are dealt to files before their payload is made; row groups are small, so that a file is read by many tasks.
    """
    out = folder(spark, "ingest")
    laid = envelopes.repartitionByRange(FILES, "file").sortWithinPartitions("turn").select("turn", (F.col(payload) if isinstance(payload, str) else payload).alias("payload"), "file")
    laid.write.option("parquet.block.size", ROW_GROUP).partitionBy("file").parquet(f"{out}/sent")
    sent = spark.readStream.schema("turn long, payload string, file int").option("maxFilesPerTrigger", AT_ONCE).parquet(f"{out}/sent")
    ingest.receive(sent, out, f"{out}/checkpoint", "2024-06-01").start().awaitTermination()
    return spark.read.schema("turn long, batch_id string, state string, error string, accepted long, duplicate long, rejected long, status string").parquet(f"{out}/responses")


def collected(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines (raw_payload), written as log files, as the collector's stream brings them."""
    out = folder(spark, "collector")
    lines.select("raw_payload").write.text(f"{out}/logs")
    collector.register(spark)
    return run(spark, spark.readStream.format("log_lines").option("path", f"{out}/logs").option("sourceType", "syslog").load(), "collected")
