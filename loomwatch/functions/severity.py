"""Severities, priorities and risk as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by rank, priorities by least risk, default risk and priority of an incident made from one event.
SEVERITIES = ("info", "low", "medium", "high", "critical")
PRIORITIES = ((80, "p1"), (60, "p2"), (40, "p3"), (20, "p4"))
RISK_WEIGHT_SEVERITY, RISK_WEIGHT_CONFIDENCE, RISK_WEIGHT_ASSET, RISK_WEIGHT_INTEL = 3.0, 1.0, 2.0, 2.5
EVENT_RISK = {"critical": 95, "high": 80, "medium": 60, "low": 30, "info": 10}


def lookup(key: Column, table: dict, default: object = None) -> Column:
    """The table's value for the key, else the default."""
    found = F.lit(default)
    for k, v in reversed(table.items()):
        found = F.when(key == F.lit(k), F.lit(v)).otherwise(found)
    return found


def rank(severity: Column, unknown: int | None = 0) -> Column:
    return lookup(F.lower(severity), {s: i for i, s in enumerate(SEVERITIES)}, unknown)


def by_rank(rank_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank_.cast("int") + 1)


def known(severity: Column) -> Column:
    """Lower case; anything unknown or null is medium."""
    low = F.lower(F.trim(severity))
    return F.when(low.isin(*SEVERITIES), low).otherwise(F.lit("medium"))


def priority(risk: Column) -> Column:
    return reduce(lambda found, p: F.when(risk >= p[0], p[1]).otherwise(found), reversed(PRIORITIES), F.lit("p5"))


def risk(severity: Column, confidence: Column, factors: list[tuple[float, Column]] = (), base: float = 0) -> Column:
    """0..100: severity rank and confidence, with further factors (weight, 0..1), scaled over the base; half to even."""
    weights = RISK_WEIGHT_SEVERITY + RISK_WEIGHT_CONFIDENCE + sum(w for w, _ in factors)
    total = F.lit(RISK_WEIGHT_SEVERITY) * rank(severity) / F.lit(len(SEVERITIES) - 1.0) + F.lit(RISK_WEIGHT_CONFIDENCE) * confidence
    for weight, value in factors:
        total = total + F.lit(float(weight)) * value
    scaled = F.lit(float(base)) + total / F.lit(weights) * F.lit(100.0 - base)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(scaled).cast("int")))


def asset_factor(criticality: Column) -> tuple[float, Column]:
    return RISK_WEIGHT_ASSET, F.greatest(F.lit(0.0), F.least(F.lit(1.0), criticality / F.lit(100.0)))


def intel_factor(score: Column) -> tuple[float, Column]:
    return RISK_WEIGHT_INTEL, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
