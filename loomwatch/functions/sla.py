"""Service levels: hours by severity, deadlines and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwatch.functions.severity import lookup

# Hours by severity, hours of anything else, share of the time that is left when a warning starts.
HOURS = {"critical": 1, "high": 4, "medium": 24, "low": 72, "info": 72}
OTHER_HOURS, WARNING_SHARE = 24, 0.3


def hours(severity: Column) -> Column:
    return lookup(F.lower(severity), HOURS, OTHER_HOURS)


def deadline(severity: Column, created: Column) -> Column:
    return created + F.make_interval(hours=hours(severity))


def seconds_left(severity: Column, created: Column, now: Column) -> Column:
    return (F.unix_micros(deadline(severity, created)) - F.unix_micros(now)) / F.lit(1_000_000.0)


def state(severity: Column, created: Column, closed: Column, now: Column) -> Column:
    """Closed: met or missed. Open: overdue, warning or ok."""
    due, left = deadline(severity, created), seconds_left(severity, created, now)
    is_open = F.when(due < now, "overdue").when(left <= hours(severity) * F.lit(3600 * WARNING_SHARE), "warning").otherwise("ok")
    return F.when(closed.isNotNull(), F.when(closed <= due, "met").otherwise("missed")).otherwise(is_open)


def remaining(severity: Column, created: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), seconds_left(severity, created, now))


def rank(state_: Column) -> Column:
    """Overdue and missed first, then warnings, then the rest."""
    return F.when(state_.isin("overdue", "missed"), 0).when(state_ == "warning", 1).otherwise(2)
