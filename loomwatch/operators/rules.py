"""Rules as transformations of events to findings, their registry and outcomes."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions import severity

# Fields that gating looks at.
PRESENCE = ("ip_src", "ip_dst", "user", "hostname", "source_host", "event_category", "event_action", "process", "command_line")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    matches: Callable[[DataFrame], DataFrame] | Column  # the events that fit, with what columns they have; or a condition of a single event
    severity: str = "medium"
    confidence: float = 1.0
    risk_score: int | None = None
    priority: int = 100
    required: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    enabled: bool = True


def in_order(held: dict[str, Any]) -> list[Any]:
    """Those enabled (with enabled, priority and depends_on): dependencies first, then by priority and order of registration; ValueError for missing, disabled or circular ones."""
    on = {k: r for k, r in held.items() if r.enabled}
    place = {k: i for i, k in enumerate(held)}
    for k, r in on.items():
        if missing := [d for d in r.depends_on if d not in on]:
            raise ValueError(f"{k} depends on {missing}")
    waiting = {k: set(r.depends_on) for k, r in on.items()}
    ready = [(r.priority, place[k], k) for k, r in on.items() if not r.depends_on]
    heapq.heapify(ready)
    out = []
    while ready:
        _, _, k = heapq.heappop(ready)
        out.append(on[k])
        for other, left in waiting.items():
            if k in left:
                left.discard(k)
                if not left:
                    heapq.heappush(ready, (on[other].priority, place[other], other))
    if len(out) < len(on):
        raise ValueError("they depend on each other in a circle")
    return out


@dataclass
class Registry:
    rules: dict[str, Rule] = field(default_factory=dict)

    def register(self, rule: Rule) -> None:
        if rule.rule_id in self.rules:
            raise ValueError(f"registered already: {rule.rule_id}")
        self.rules[rule.rule_id] = rule

    def enable(self, rule_id: str, on: bool = True) -> None:
        r = self.rules[rule_id]
        self.rules[rule_id] = Rule(**{**r.__dict__, "enabled": on})

    def ordered(self) -> list[Rule]:
        """The enabled rules, as in_order() has it."""
        return in_order(self.rules)

    def unregister(self, rule_id: str) -> Rule:
        return self.rules.pop(rule_id)

    def get(self, rule_id: str) -> Rule | None:
        return self.rules.get(rule_id)

    def stats(self) -> dict:
        by_priority: dict[int, int] = {}
        for r in self.rules.values():
            by_priority[r.priority] = by_priority.get(r.priority, 0) + 1
        return {"total": len(self.rules), "enabled": sum(r.enabled for r in self.rules.values()), "by_priority": by_priority}


def present(df: DataFrame, names: tuple[str, ...]) -> Column:
    """All fields are there and not empty; a field that the table lacks is not."""
    if any(n not in df.columns for n in names):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.col(n).cast("string") != "") for n in names], F.lit(True))


def findings(events: DataFrame, rules: list[Rule], columns: list[str]) -> DataFrame:
    """One row a rule and event that fits, with the rule's severity, confidence and risk; columns are the event's to keep.

    All conditions of single events are tested in one scan; each rule over windows has its own.
    """

    def made(r: Rule) -> Column:
        return F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"),
            F.lit(r.risk_score).cast("int").alias("risk_score"), F.array(*[F.lit(t) for t in r.tags]).cast("array<string>").alias("tags"),
        )

    routed = lambda r: F.col("category").isin(*r.categories) if r.categories else F.lit(True)
    single = [r for r in rules if isinstance(r.matches, Column)]
    parts = [
        r.matches(events.where(routed(r) & present(events, r.required))).select(*columns, F.inline(F.array(made(r)))) for r in rules if not isinstance(r.matches, Column)
    ]
    if single:
        hits = [F.when(routed(r) & present(events, r.required) & r.matches, made(r)) for r in single]
        parts.append(events.select(*columns, F.inline(F.array_compact(F.array(*hits)))))
    return reduce(lambda a, b: a.unionByName(b), parts)


@dataclass
class Measured:
    """Findings of several rules with what each did; metrics are there once an action has run over all findings."""

    found: DataFrame
    observations: dict[str, Observation]
    failed: dict[str, str]

    def metrics(self, spark: SparkSession) -> DataFrame:
        """rule_id, executions (events that the rule was applied to), detections, failure (why it could not be planned; null otherwise)."""
        rows = [(r, *(o.get[n] for n in ("executions", "detections")), None) for r, o in self.observations.items()]
        rows += [(r, 0, 0, why) for r, why in self.failed.items()]
        return spark.createDataFrame(rows, "rule_id string, executions long, detections long, failure string")


def measured(events: DataFrame, rules: list[Rule], columns: list[str], name: str = "rules") -> Measured:
    """findings() rule by rule, each apart from the others: one that does not fit the events is left out with its reason.

    What each is applied to and finds is observed in the running plan, without another pass; a listener of a stream
    gets the same metrics with each micro-batch. All rules have a scan of their own here.
    """
    parts, observations, failed = [], {}, {}
    for k, r in enumerate(rules):
        try:
            part = findings(events, [r], columns)
            part.schema  # plans it  # noqa: B018
        except AnalysisException as error:
            failed[r.rule_id] = error.getCondition() or str(error).splitlines()[0]
            continue
        seen = Observation(f"{name}-{k}-{r.rule_id}")
        applied = (F.col("category").isin(*r.categories) if r.categories else F.lit(True)) & present(events, r.required)
        if isinstance(r.matches, Column):
            hit = F.coalesce(applied & r.matches, F.lit(False))
            watched = events.observe(seen, F.count_if(F.coalesce(applied, F.lit(False))).alias("executions"), F.count_if(hit).alias("detections"))
            parts.append(findings(watched, [r], columns))
        else:
            of = events.withColumn("__applied", F.coalesce(applied, F.lit(False)))
            tagged = findings(of, [r], [*columns, "__applied"]).select(*columns, "rule_id", "severity", "confidence", "risk_score", "tags", F.lit(True).alias("__hit"))
            rest = of.select(*[F.col(c) for c in columns], *[F.lit(None).cast(tagged.schema[c].dataType).alias(c) for c in ("rule_id", "severity", "confidence", "risk_score", "tags")], F.when(F.col("__applied"), False).alias("__hit"))
            both = tagged.unionByName(rest).observe(seen, F.count_if(~F.col("__hit")).alias("executions"), F.count_if("__hit").alias("detections"))
            parts.append(both.where("__hit").drop("__hit"))
        observations[r.rule_id] = seen
    found = reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    return Measured(found, observations, failed)


def outcomes(found: DataFrame) -> DataFrame:
    """Per event: number of findings, highest severity, rules sorted."""
    top = severity.by_rank(F.max(severity.rank(F.col("severity")))).alias("severity")
    return found.groupBy("event_id").agg(F.count("*").alias("findings"), top, F.array_sort(F.collect_set("rule_id")).alias("rules"))


def correlated(events: DataFrame, found: DataFrame) -> DataFrame:
    """All events with the array of their matches, empty without."""
    matches = found.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "severity", "tags"))).alias("matches"))
    return events.join(matches, "event_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<rule_id:string,severity:string,tags:array<string>>>")))


def simulate(payloads: DataFrame, rules: list[dict], text: str = "text", payload_rule: str = "payload_rule") -> DataFrame:
    """Which enabled rules (rule_id, category, severity, tags, enabled) a payload would fire, with reason and score.

    The rules are a constant array that is filtered for each payload; a tag outweighs the category, that the id.
    """
    low, named = F.lower(text), F.lower(payload_rule)
    scores = {"critical": 90, "high": 75, "medium": 50, "low": 25}
    hits = []
    for r in sorted(rules, key=lambda r: r["rule_id"]):
        if not r.get("enabled", True):
            continue
        by_tag = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in r["tags"]], F.lit(False))
        by_category = F.contains(low, F.lit(r["category"].lower())) if r["category"] else F.lit(False)
        reason = F.when(by_tag, "tag").when(by_category, "category").when(F.contains(named, F.lit(r["rule_id"].lower())), "rule_id")
        hits.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), reason.alias("reason"), F.lit(scores.get(r["severity"], 50)).alias("score")))
    if not hits:
        hits = [F.struct(F.lit("").alias("rule_id"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("score"))]
    found = F.filter(F.array(*hits), lambda h: h["reason"].isNotNull())
    return payloads.withColumn("__hit", F.explode(found)).select(*payloads.columns, "__hit.*")
