"""Filters, paging and search over alerts, incidents and cases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of a page.
LEAST_PAGE, MOST_PAGE = 1, 1000


@dataclass(frozen=True)
class Filter:
    field: str
    op: str  # eq neq gt gte lt lte contains
    value: Any

    def column(self, columns: list[str]) -> Column:
        if self.field not in columns:
            raise ValueError(f"no such column: {self.field}")
        c, v = F.col(self.field), F.lit(self.value)
        made = {
            "eq": lambda: c == v,
            "neq": lambda: c != v,
            "gt": lambda: c > v,
            "gte": lambda: c >= v,
            "lt": lambda: c < v,
            "lte": lambda: c <= v,
            "contains": lambda: c.ilike(f"%{self.value}%"),
        }
        if self.op not in made:
            raise ValueError(f"no such operator: {self.op}")
        return made[self.op]()


def where_all(df: DataFrame, filters: list[Filter]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [f.column(df.columns) for f in filters], F.lit(True)))


def page(df: DataFrame, sort_by: str, limit: int = 100, offset: int = 0, descending: bool = True, tie: str = "id") -> DataFrame:
    """The page's rows in order: a top-k of offset + limit rows, not a sort of the table."""
    if sort_by not in df.columns:
        raise ValueError(f"no such column: {sort_by}")
    limit, offset = max(LEAST_PAGE, min(MOST_PAGE, limit)), max(0, offset)
    return df.orderBy(F.desc(sort_by) if descending else F.asc(sort_by), F.asc(tie)).offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """total and has_more of a filtered table."""
    limit, offset = max(LEAST_PAGE, min(MOST_PAGE, limit)), max(0, offset)
    return df.agg(F.count("*").alias("total")).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def date_range(df: DataFrame, start: str, end: str, column: str = "created_at") -> DataFrame:
    return df.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def text_match(c: str, value: str, exact: bool) -> Column:
    return F.col(c) == value if exact else F.col(c).ilike(f"%{value}%")


def any_member(c: str, value: str) -> Column:
    """Whether a member of the array contains the value, case aside."""
    return F.coalesce(F.exists(c, lambda x: x.ilike(f"%{value}%")), F.lit(False))


def search_alerts(alerts: DataFrame, term: str | None = None, exact: bool = False, ioc: str | None = None, mitre: str | None = None, **equal: str | None) -> DataFrame:
    """All given criteria; equal: rule_id, asset_id, user, file_hash, severity, status."""
    found = alerts
    if term:
        found = found.where(text_match("title", term, exact))
    for c, v in (("ioc_ids", ioc), ("mitre", mitre)):
        if v:
            found = found.where(any_member(c, v))
    for c, v in equal.items():
        if v:
            found = found.where(F.col(c) == v)
    return found


def search_entities(entities: DataFrame, term: str | None = None, exact: bool = False, sets: dict[str, str] | None = None, **equal: str | None) -> DataFrame:
    """Incidents or cases: title, members of array columns and equal columns."""
    found = entities.where(text_match("title", term, exact)) if term else entities
    for c, v in (sets or {}).items():
        found = found.where(any_member(c, v))
    for c, v in equal.items():
        if v:
            found = found.where(F.col(c) == v)
    return found


def search_all(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """One tagged table of the parts' rows; columns that a part lacks are null."""
    tagged = [df.select(F.lit(name).alias("entity"), *[c for c in columns if c in df.columns]) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def grid(df: DataFrame, term: str | None, columns: list[str], **equal: str | None) -> DataFrame:
    """The console's grids: a term in any of the columns, case aside, and equal columns ('all' or None for any)."""
    found = df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term.lower()))) if term else df
    for c, v in equal.items():
        if v and v != "all":
            found = found.where(F.col(c) == v)
    return found


PERIODS = {"24h": 1, "7d": 7}  # days; any other is all time


def since(df: DataFrame, period: str | None, now: Column, ts: str = "first_seen") -> DataFrame:
    """Rows of the period before now, its start included; those without a time are of no period."""
    return df.where(F.col(ts) >= now - F.make_interval(days=F.lit(PERIODS[period]))) if period in PERIODS else df


def triage(alerts: DataFrame, now: Column, term: str | None = None, period: str | None = None, columns: list[str] | None = None, **equal: str | None) -> DataFrame:
    """The triage list: a term in title, source, host or rule, equal columns (severity, source, host, rule) and a period of first_seen."""
    return since(grid(alerts, term, columns or ["title", "source", "host", "rule"], **equal), period, now)


def sla_bucket(state: Column) -> Column:
    """How the queue is filtered by service level: overdue (missed too), warning, ok, and none without one."""
    return F.when(state.isNull(), "none").when(state.isin("overdue", "missed"), "overdue").when(state == "warning", "warning").otherwise("ok")


def queue_filter(items: DataFrame, sla: str | None = None, ownership: str | None = None, **equal: str | None) -> DataFrame:
    """The decision queue's filters: equal columns (severity, kind, status), a service level's bucket, assigned or unassigned; 'all' or None for any. An empty owner is none."""
    found = grid(items, None, [], **equal)
    if sla and sla != "all":
        found = found.where(sla_bucket(F.col("sla_state")) == sla)
    owned = F.coalesce(F.col("owner"), F.lit("")) != ""
    return found.where(owned if ownership == "assigned" else ~owned) if ownership in ("assigned", "unassigned") else found


def facets(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def latest_per_key(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each key of a change log."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
