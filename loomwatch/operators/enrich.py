"""Enrichment: left joins against dimensions and one array of what was found."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.operators.rules import in_order

#: Dimensions of at most so many rows are broadcast; larger ones are joined as Spark sees fit.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Provider:
    """Looks up events by keys (event column -> dimension column), the first that finds wins; data are the columns to keep."""

    kind: str
    name: str
    dimension: DataFrame
    keys: list[tuple[str, str]]
    data: list[str]
    categories: tuple[str, ...] = field(default=())  # none: all
    priority: int = 100
    depends_on: tuple[str, ...] = ()  # names
    enabled: bool = True


def ordered(providers: list[Provider], category: str | None = None) -> list[Provider]:
    """The enabled providers, dependencies first, then by priority and place in the list; of a category, those that are for it."""
    if len({p.name for p in providers}) < len(providers):
        raise ValueError("providers share a name")
    found = in_order({p.name: p for p in providers})
    return [p for p in found if category is None or not p.categories or category in p.categories]


def sized(dimension: DataFrame) -> DataFrame:
    few = dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(dimension) if few else dimension


def look_up(events: DataFrame, provider: Provider, out: str | None = None) -> DataFrame:
    """Adds a struct column out (or named as the provider's kind), null where nothing was found. Of rows with one key value one counts."""
    found = []
    for i, (event_key, key) in enumerate(provider.keys):
        held = f"__{provider.kind}{i}"
        rows = provider.dimension.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{held}k"))
        one = sized(rows.agg(F.min(F.struct(*provider.data)).alias(held)))
        events = events.join(one, F.col(event_key) == F.col(f"{held}k"), "left").drop(f"{held}k")
        found.append(held)
    value = F.coalesce(*found)
    if provider.categories:
        value = F.when(F.col("category").isin(*provider.categories), value)
    return events.withColumn(out or provider.kind, value).drop(*found)


def enrich(events: DataFrame, providers: list[Provider]) -> DataFrame:
    """Adds enrichments, array<struct<kind, provider, data>> of JSON data, in the providers' order and without repetition."""
    taken = {p.kind: f"__found_{p.kind}" for p in providers}  # an event may have a column of that name
    for p in providers:
        events = look_up(events, p, taken[p.kind])
    made: list[Column] = [
        F.when(F.col(taken[p.kind]).isNotNull(), F.struct(F.lit(p.kind).alias("kind"), F.lit(p.name).alias("provider"), F.to_json(taken[p.kind]).alias("data"))) for p in providers
    ]
    return events.withColumn("enrichments", F.array_distinct(F.array_compact(F.array(*made)))).drop(*taken.values())
