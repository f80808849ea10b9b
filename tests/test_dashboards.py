"""Canonical events and their checks, counts of cases, order of providers, metrics of incidents, console filters, the audit log."""

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import cases, enrich, kpi, normalize, search
from loomwatch.sources import stores

NOW = lambda: F.lit("2024-01-08 00:00:00").cast("timestamp")


def test_canonical_events_and_quarantine(spark):
    rows = [("e1", "syslog", "h", 0.5, "1.0.0", ["b", "a", "b"]), (" ", "syslog", "h", 1.0, "1.0.0", None), ("e3", None, "", 1.5, "2", []), ("e4", "x", "h", None, None, None)]
    events = spark.createDataFrame(rows, "event_id string, source_type string, source_host string, confidence double, schema_version string, tags array<string>").withColumn("more", F.lit(1))
    held = normalize.canonical(events, NOW())
    assert held.columns == list(normalize.CANONICAL) and len(held.columns) == 24
    ok, refused = normalize.accepted(held)
    got = {r["event_id"]: r for r in ok.collect()}
    assert set(got) == {"e1", "e4"} and got["e1"]["tags"] == ["a", "b"] and got["e4"]["confidence"] == 1.0 and got["e4"]["severity"] == "info" and got["e4"]["metadata"] == "{}"
    assert {r["event_id"]: r["errors"] for r in refused.collect()} == {" ": ["event_id"], "e3": ["source_type", "source_host", "confidence", "schema_version"]}


def test_sensor_events_that_are_no_json_are_refused(spark):
    sent = spark.createDataFrame([("no json",), (None,), ('{"event_id":"a","asset":{"hostname":"h"},"metadata":{"correlation_id":null}}',)], "payload string")
    ok, refused = normalize.accepted(normalize.sensor_canonical(sent, "payload", NOW(), NOW()))
    assert [(r["event_id"], r["trace_id"], r["tags"]) for r in ok.collect()] == [("a", "a", [])] and refused.count() == 2


def test_counts_of_cases(spark):
    held = spark.createDataFrame([("a",), ("b",), (None,)], "case_id string")
    log = lambda *ids: spark.createDataFrame([(i,) for i in ids], "case_id string")
    got = cases.with_counts(held, comments=log("a", "a", "z"), evidence=log("b"), tasks=log(), attachments=log("a", None)).collect()
    assert {r["case_id"]: tuple(r)[1:] for r in got} == {"a": (2, 0, 0, 1), "b": (0, 1, 0, 0), None: (0, 0, 0, 0)}


def test_order_of_providers(spark):
    df = spark.range(1)
    one = lambda name, **more: enrich.Provider(name, name, df, [], [], **more)
    held = [one("geo", depends_on=("asset",), priority=1), one("asset", priority=9, categories=("auth",)), one("user"), one("off", enabled=False)]
    assert [p.name for p in enrich.ordered(held)] == ["asset", "geo", "user"]
    assert [p.name for p in enrich.ordered(held, "network")] == ["geo", "user"]
    for bad in ([one("a", depends_on=("off",)), held[-1]], [one("a", depends_on=("b",)), one("b", depends_on=("a",))], [one("a"), one("a")]):
        with pytest.raises(ValueError):
            enrich.ordered(bad)


def test_incident_metrics(spark):
    rows = [("r1", "created", 3), ("r1", "created", 5), ("r1", "deduplicated", 2), ("r2", "failed", None), (None, "reopened", 1)]
    got = {r["key"]: tuple(r)[1:] for r in kpi.incident_metrics(spark.createDataFrame(rows, "key string, change string, alerts long")).collect()}
    assert got == {"r1": (2, 1, 0, 0, 8, 4.0), "r2": (0, 0, 0, 1, 0, 0.0), "": (0, 0, 1, 0, 0, 0.0), None: (2, 1, 1, 1, 8, 4.0)}


def test_blocks_of_nothing(spark):
    a = spark.createDataFrame([], "status string, severity string, risk int")
    one = kpi.component_block(a, a, spark.createDataFrame([], "status string, closed_at timestamp")).collect()
    assert len(one) == 1 and one[0]["total_alerts"] == 0 and one[0]["avg_risk_score"] == 0 and one[0]["sla_low_hours"] == 72
    block = spark.createDataFrame([(90,)], "mttr long")
    series = spark.createDataFrame([("2024-01-01 00:01:00", 7), ("2024-01-01 00:00:00", 9)], "minute string, events long").withColumn("minute", F.col("minute").cast("timestamp"))
    assert tuple(kpi.console_metrics(block, series).collect()[0]) == (2, 7)


def test_console_filters(spark):
    rows = [(1, "A%b", "2024-01-01 00:00:00", None, ""), (2, "xA%B", "2023-12-31 23:59:59", "missed", "o"), (3, "ab", None, "met", None), (4, None, "2024-01-07 00:00:00", "warning", "o")]
    df = spark.createDataFrame(rows, "id int, title string, seen string, sla_state string, owner string").withColumn("first_seen", F.col("seen").cast("timestamp"))
    ids = lambda found: [r["id"] for r in found.orderBy("id").collect()]
    listed = lambda *more: ids(search.triage(df, NOW(), *more, columns=["title"]))
    assert listed("a%B", "all") == [1, 2] and listed(None, "7d") == [1, 4] and listed(None, "24h") == [4] and listed("", None) == [1, 2, 3, 4]
    assert ids(search.queue_filter(df, sla="none")) == [1] and ids(search.queue_filter(df, sla="overdue")) == [2] and ids(search.queue_filter(df, sla="ok")) == [3]
    assert ids(search.queue_filter(df, ownership="unassigned")) == [1, 3] and ids(search.queue_filter(df, sla="warning", ownership="assigned")) == [4]


def test_audit_log_and_trail_pages(spark, tmp_path):
    entries = spark.createDataFrame([("ann", "close", "2024-01-01"), ("bob", "open", "2024-01-02")], "actor string, action string, day string").withColumn("ts", F.col("day").cast("timestamp"))
    for batch in ("1", "1", "2"):
        stores.append_audit(entries.drop("day"), str(tmp_path), batch)
    held = stores.audit_trail(spark, str(tmp_path))
    assert held.count() == 4 and held.select("audit_id").distinct().count() == 2
    assert [r["action"] for r in stores.audit(held, actor="bob").collect()] == ["open", "open"]
    trail = spark.range(5).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    assert [r["event_id"] for r in stores.trail_page(trail, 2, 1).collect()] == [3, 2]
