"""Parsed rows to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions.keys import filled
from loomwatch.functions.severity import lookup

# Version of the schema; category and action by sensor event type.
SCHEMA_VERSION = "1.0.0"
SENSOR_TYPES = {
    "fim.baseline.created": ("file", "baseline_created"),
    "fim.scan.completed": ("file", "scan_completed"),
    "fim.file.added": ("file", "created"),
    "fim.file.modified": ("file", "modified"),
    "fim.file.removed": ("file", "deleted"),
    "hash.verified": ("file", "hash_verified"),
    "hash.mismatch": ("file", "hash_changed"),
    "alert.created": ("alert", "created"),
    "alert.updated": ("alert", "updated"),
}

#: Columns by name, over those of the parsed rows.
Strategy = dict[str, Column]


def classify(category: Column, action: Column, confidence: Column) -> Column:
    """Severity of an event; the first rule that fits."""
    return (
        F.when((category == "auth") & action.isin("reject", "error"), "high")
        .when((category == "auth") & (action == "accept"), "low")
        .when((category == "network") & (action == "reject"), "high")
        .when(category == "threat", "critical")
        .when(confidence < 0.5, "low")
        .otherwise("info")
    )


def first_filled(*names: str) -> Column:
    """The first field (of the map fields) that is neither null nor empty; the last may be empty."""
    *most, last = [F.col("fields")[n] for n in names]
    return F.coalesce(*[filled(c) for c in most], last)


def projected(ip_src: Column, ip_dst: Column, user: Column, process: Column, command: Column) -> Strategy:
    columns = {"ip_src": ip_src, "ip_dst": ip_dst, "user": user, "process": process, "command_line": command}
    return columns | {"severity": classify(F.col("category"), F.col("action"), F.col("confidence")), "schema_version": F.lit(SCHEMA_VERSION)}


def default_strategy() -> Strategy:
    return projected(first_filled("src_ip", "source_ip"), first_filled("dst_ip", "destination_ip"), first_filled("user"), first_filled("process"), first_filled("command_line"))


def windows_strategy() -> Strategy:
    return projected(first_filled("source_ip"), first_filled("destination_ip"), first_filled("target_user_name"), first_filled("process_name"), first_filled("command_line"))


def normalize(parsed: DataFrame, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    """Each row by the strategy of its source_type, the default for others, in one scan; rows need fields, category, action, confidence."""
    strategies = {"syslog": default_strategy(), "windows": windows_strategy()} if strategies is None else strategies
    names = list(dict.fromkeys(n for s in (*strategies.values(), default_strategy()) for n in s))
    out = {}
    for n in names:
        value = default_strategy().get(n, F.lit(None))
        for kind, strategy in strategies.items():
            value = F.when(F.coalesce(F.col("source_type") == kind, F.lit(False)), strategy.get(n, F.lit(None))).otherwise(value)
        out[n] = value
    return parsed.withColumns(out)


def version_ok(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of this schema version, and the others for quarantine."""
    ok = F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False))
    return events.where(ok), events.where(~ok)


def sensor_category(event_type: Column) -> Column:
    return lookup(event_type, {k: v[0] for k, v in SENSOR_TYPES.items()})


def sensor_action(event_type: Column) -> Column:
    return lookup(event_type, {k: v[1] for k, v in SENSOR_TYPES.items()})


def normalize_sensor(events: DataFrame) -> DataFrame:
    """Adds category, action and trace_id (the correlation id, else the event's) to sensor events with event_type, event_id, correlation_id."""
    return events.withColumns(
        {"category": sensor_category(F.col("event_type")), "action": sensor_action(F.col("event_type")), "trace_id": F.coalesce(filled(F.col("correlation_id")), F.col("event_id"))}
    )


def mitre_techniques(values: Column, most: int = 16) -> Column:
    """Distinct technique ids, in order, of an array of texts."""
    cut = F.transform(values, lambda v: F.substring(F.trim(v), 1, most))
    return F.array_distinct(F.filter(cut, lambda v: v.rlike(r"^T[0-9]{4}(\.[0-9]{3})?$")))


def payload(event: list[str], sets: list[str]) -> Column:
    """The event's columns as JSON, its sets sorted."""
    return F.to_json(F.struct(*event, *[F.array_sort(c).alias(c) for c in sets]))


#: The canonical event: column, type, default (None: required or null).
CANONICAL: dict[str, tuple[str, Column | None]] = {
    **dict.fromkeys(("event_id", "trace_id"), ("string", None)), **dict.fromkeys(("timestamp", "received_at"), ("timestamp", None)),
    **dict.fromkeys(("source_type", "source_host", "hostname"), ("string", None)), **dict.fromkeys(("event_category", "event_action"), ("string", "")), "severity": ("string", "info"),
    **dict.fromkeys(("user", "process", "command_line", "ip_src", "ip_dst", "vendor", "product"), ("string", None)), "event_original": ("string", ""),
    **dict.fromkeys(("normalized_fields", "tags"), ("array<string>", ())), "confidence": ("double", 1.0), "metadata": ("string", "{}"), "schema_version": ("string", SCHEMA_VERSION),
    "normalized_at": ("timestamp", None),
}


def canonical(events: DataFrame, now: Column, **columns: Column) -> DataFrame:
    """Events with exactly the canonical columns: those given, those that the events have, else the default. Sets are sorted and distinct; metadata is JSON."""
    out = []
    for name, (kind, default) in CANONICAL.items():
        empty = F.array() if default == () else F.lit(default)
        value = columns.get(name, F.col(name) if name in events.columns else now if name == "normalized_at" else empty).cast(kind)
        if default is not None:
            value = F.coalesce(value, empty.cast(kind))
        out.append((F.array_sort(F.array_distinct(value)) if kind.startswith("array") else value).alias(name))
    return events.select(*out)


def canonical_errors() -> Column:
    """What a canonical event is refused for: the names of the columns at fault."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    faults = {c: blank(c) for c in ("event_id", "source_type", "source_host")}
    faults |= {"confidence": ~F.col("confidence").between(0.0, 1.0), "schema_version": F.col("schema_version") != SCHEMA_VERSION}
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in faults.items()]))


def accepted(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical events without errors, and the others with theirs for quarantine."""
    found = events.withColumn("errors", canonical_errors())
    return found.where(F.size("errors") == 0).drop("errors"), found.where(F.size("errors") > 0)


# What the sensor's normalizer takes over.
SENSOR_FIELDS = ("asset", "event_type", "evidence", "metadata", "severity", "source", "timestamp")


def sensor_canonical(events: DataFrame, payload: str, received_at: Column, now: Column, source_type: str = "sensor", vendor: str | None = None, product: str | None = None) -> DataFrame:
    """Sensor events (JSON that the contract accepts) as canonical events, other columns aside.

    The trace is the correlation id, else the event's own; the original is kept as canonical JSON, and the metadata
    hold the source, its sequence and severity, the asset, the evidence and the source's own metadata.
    """
    body = F.try_parse_json(F.col(payload))
    held = events.select(body.alias("__v"), received_at.alias("__received"))
    text = lambda path: F.try_variant_get("__v", f"$.{path}", "string")
    part = lambda path: F.try_variant_get("__v", f"$.{path}", "variant")
    metadata = F.struct(
        part("asset").alias("asset"), text("schema_version").alias("contract_schema_version"), part("evidence").alias("evidence"), text("event_id").alias("origin_event_id"),
        text("source.component").alias("source_component"), text("source.instance_id").alias("source_instance_id"), part("metadata").alias("source_metadata"),
        text("source.product_version").alias("source_product_version"), F.try_variant_get("__v", "$.sequence", "decimal(38,0)").alias("source_sequence"), text("severity").alias("source_severity"),
    )
    return canonical(
        held, now, event_id=text("event_id"), trace_id=F.coalesce(text("metadata.correlation_id"), text("event_id")), timestamp=text("timestamp").try_cast("timestamp"), received_at=F.col("__received"),
        source_type=F.lit(source_type), source_host=text("asset.hostname"), hostname=text("asset.hostname"), event_category=sensor_category(text("event_type")), event_action=sensor_action(text("event_type")),
        severity=text("severity"), vendor=F.lit(vendor), product=F.lit(product), event_original=F.to_json("__v"), normalized_fields=F.array(*[F.lit(c) for c in SENSOR_FIELDS]),
        tags=F.try_variant_get("__v", "$.metadata.tags", "array<string>"), metadata=F.to_json(metadata),
    )
