"""Fingerprints, canonical JSON and bounded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The event fields that identify an alert besides its rule.
IDENTITY = ("ip_dst", "ip_src", "source_host", "user")
# What the key of an incident's fingerprint is called, by the column that groups alerts.
GROUP_KEYS = {"asset_id": "asset", "rule_id": "rule", "user": "user"}


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def fingerprint(parts: dict[str, Column]) -> Column:
    """16 hex digits of the compact JSON of the parts by name; nulls are left out."""
    return short_hash(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])))


def escaped(json: Column) -> Column:
    """JSON with all characters beyond ASCII as \\u escapes, those beyond the basic plane as two."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def char(c: Column) -> Column:
        n = F.ascii(c)
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(json.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(json, ""), char), "")).otherwise(json)


def incident_fingerprint(by: dict[str, Column]) -> Column:
    """16 hex digits of the compact ASCII JSON of what a group is keyed by; nulls are part of it."""
    named = {GROUP_KEYS.get(k, k): c for k, c in by.items()}
    return short_hash(escaped(F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]), {"ignoreNullFields": "false"})))


def alert_fingerprint(rule: Column, fields: dict[str, Column] | None = None, extra: dict[str, Column] | None = None) -> Column:
    """Of the rule and the identifying fields; extra parts replace fields of the same name."""
    fields = {k: F.col(k) for k in IDENTITY} if fields is None else fields
    return fingerprint({"rule_id": rule, **fields, **(extra or {})})


def canonical_json(text: Column) -> Column:
    """Sorted keys, compact; null for text that is not JSON, has a key twice or a number that is not finite."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def bounded(text: Column, most: int) -> Column:
    """Trimmed and cut; null if nothing is left."""
    return F.nullif(F.substring(F.trim(text), 1, most), F.lit(""))


def filled(text: Column) -> Column:
    """The text; null if empty."""
    return F.nullif(text, F.lit(""))
