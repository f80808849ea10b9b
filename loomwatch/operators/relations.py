"""What belongs together: indicators and assets to incidents and cases, cases to alerts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def related(values: DataFrame, value: str, entities: DataFrame, members: str, entity_id: str) -> DataFrame:
    """value, entity_id where the entity's array holds the value: an equi-join on the exploded array."""
    held = entities.select(F.col(entity_id).alias("entity_id"), F.explode(F.array_distinct(members)).alias(value))
    return values.select(value).distinct().join(held, value)


def related_counts(values: DataFrame, value: str, entities: DataFrame, members: str, entity_id: str) -> DataFrame:
    """All values with the number of entities that hold them."""
    found = related(values, value, entities, members, entity_id).groupBy(value).agg(F.count("*").alias("n"))
    return values.join(found, value, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def case_alerts(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """case_id with the columns of each of its alerts that exists."""
    return cases.select("case_id", F.explode("alert_ids").alias("alert_id")).join(alerts, "alert_id")


def case_trail(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Each case with the sorted trail of events whose correlation id is its incident."""
    trail = events.groupBy("correlation_id").agg(F.array_sort(F.collect_list(F.struct("ts", "stage", "event_id"))).alias("trail"))
    return cases.join(trail, F.col("incident_id") == F.col("correlation_id"), "left").drop("correlation_id")


def sensor_cases(events: DataFrame, cases: DataFrame, prefix: str = "sensor-event:") -> DataFrame:
    """Sensor events with the case that was opened for them, if any."""
    held = cases.select(F.col("incident_id").alias("__key"), "case_id", F.col("status").alias("case_status"))
    return events.join(held, F.concat(F.lit(prefix), F.col("event_id").cast("string")) == F.col("__key"), "left").drop("__key")


def investigations(cases: DataFrame, alerts: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Each case with its alerts, trail and service level."""
    from loomwatch.functions import sla

    of = case_alerts(cases, alerts).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("alert_id", "rule_id", "severity"))).alias("related_alerts"))
    state = sla.state(F.col("severity"), F.col("created_at"), F.col("closed_at"), now)
    return case_trail(cases, events).join(of, "case_id", "left").withColumn("sla_state", state)
