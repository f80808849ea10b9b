"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions import checks, keys, severity, sla
from loomwatch.operators import alerts, changes, contract, dsl, enrich, incidents, kpi, normalize, plugins, relations, rules, search, syslog, windows
from loomwatch.plans import pipeline, sql
from loomwatch.sources import attachments, stores, textindex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-20 12:00:00"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt to as many tasks as there are cores, or more where they lie so: a small file whose rows are much work would be one task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def text_ts(c: str, name: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or c)


# ---- parsing and normalization

_LINES = f"""{sql.EV}, ln as (
  select event_id, ts, user_id, source_host, usr, (event_id % 192) as pri, case event_id % 4 when 0 then 'sshd' when 1 then 'kernel' when 2 then 'init' else 'app' end as process, event_id % 5 as form,
    case action when 'reject' then 'Failed password for' when 'accept' then 'Accepted login of' when 'start' then 'Started job of' else 'Seen' end || ' ' || usr as message
  from ev), parsed as (
  select *, case when form < 2 then 'rfc5424' when form < 4 then 'rfc3164' end as fmt, case when form < 2 then '- ' || message else message end as m from ln)"""
_FACILITY = "list_extract(['kernel','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','security','console','solaris-cron','local0','local1','local2','local3','local4','local5','local6','local7'], cast({0} // 8 as integer) + 1)"
_LEVEL = "list_extract(['emergency','alert','critical','error','warning','notice','informational','debug'], cast({0} % 8 as integer) + 1)"
_ACTION = "case when lower({0}) like '%accepted%' then 'accept' when lower({0}) like '%failed%' or lower({0}) like '%denied%' or lower({0}) like '%refused%' then 'reject' when lower({0}) like '%started%' or lower({0}) like '%starting%' then 'start' else 'info' end"
_WORDS = "lower({0}) like '%login%' or lower({0}) like '%authentication%' or lower({0}) like '%denied%' or lower({0}) like '%failed%'"


def _syslog_columns(df: DataFrame) -> DataFrame:
    p = F.col("parsed")
    return df.select("event_id", *[p[c].alias(c) for c in ("pri", "facility", "severity", "host", "process", "pid", "message", "category", "action")])


@query(
    f"""with {_LINES} select event_id, pri, {_FACILITY.format('pri')} as facility, {_LEVEL.format('pri')} as severity, source_host as host, process, '-' as pid, m as message,
    case when process = 'sshd' or {_WORDS.format('m')} then 'auth' else 'system' end as category, {_ACTION.format('m')} as action from parsed where form < 2"""
)
def syslog5424_parse(spark, sf_dir):
    raw = pipeline.lines(spark, sf_dir).withColumn("parsed", syslog.parse_5424(F.col("raw_payload"), F.col("received_at")))
    return _syslog_columns(raw.where("parsed is not null"))


@query(
    f"""with {_LINES} select event_id, pri, {_FACILITY.format('pri')} as facility, {_LEVEL.format('pri')} as severity, source_host as host, process, cast(user_id as varchar) as pid, m as message,
    case when process = 'sshd' then 'auth' when process = 'kernel' then 'network' when process = 'init' then 'process' when {_WORDS.format('m')} then 'auth' else 'system' end as category,
    {_ACTION.format('m')} as action from parsed where form in (2, 3)"""
)
def syslog3164_parse(spark, sf_dir):
    raw = pipeline.lines(spark, sf_dir).withColumn("parsed", syslog.parse_3164(F.col("raw_payload"), F.col("received_at")))
    return _syslog_columns(raw.where("parsed is not null"))


@query(
    f"""with {_LINES} select coalesce(fmt, 'none') as fmt, case when fmt is null then 'system' when process = 'sshd' then 'auth' when fmt = 'rfc3164' and process = 'kernel' then 'network'
    when fmt = 'rfc3164' and process = 'init' then 'process' when {_WORDS.format('m')} then 'auth' else 'system' end as category,
    case when fmt is null then 'info' else {_ACTION.format('m')} end as action, count(*) as n from parsed group by all"""
)
def parser_fallback_chain(spark, sf_dir):
    return pipeline.parsed(spark, sf_dir).groupBy(F.coalesce("parsed.format", F.lit("none")).alias("fmt"), "category", "action").agg(F.count("*").alias("n"))


@query(f"with {_LINES} select count(*) as lines, count(*) filter (form = 4) as dead_letters, count(distinct case when form = 4 then source_host end) as hosts from parsed")
def dead_letters(spark, sf_dir):
    p = pipeline.parsed(spark, sf_dir)
    dead = syslog.unparsed(p).select("event_id").withColumn("dead", F.lit(1))
    hosts = pipeline.events(spark, sf_dir).select("event_id", "source_host")
    joined = p.select("event_id").join(dead, "event_id", "left").join(hosts, "event_id")
    return joined.agg(F.count("*").alias("lines"), F.count("dead").alias("dead_letters"), F.count_distinct(F.when(F.col("dead") == 1, F.col("source_host"))).alias("hosts"))


@query(f"with p as (select l_orderkey % 200 as pri from lineitem) select pri, coalesce({_FACILITY.format('pri')}, 'facility-' || (pri // 8)) as facility, {_LEVEL.format('pri')} as severity, count(*) as n from p group by all")
def pri_decode(spark, sf_dir):
    pri = F.pmod("l_orderkey", F.lit(200)).alias("pri")
    rows = table(spark, sf_dir, "lineitem").groupBy(pri).agg(F.count("*").alias("n"))
    return rows.select("pri", syslog.facility(F.col("pri")).alias("facility"), syslog.level(F.col("pri")).alias("severity"), "n")


_CLASSIFY = "case when category = 'auth' and action in ('reject', 'error') then 'high' when category = 'auth' and action = 'accept' then 'low' when category = 'network' and action = 'reject' then 'high' when category = 'threat' then 'critical' when confidence < 0.5 then 'low' else 'info' end"


@query(
    f"""with {sql.EV} select event_id, {_CLASSIFY} as severity,
    case when event_id % 3 = 1 or event_id % 2 <> 0 then '192.168.0.' || (user_id % 250) else ip_src end as ip_src, case when event_id % 3 = 1 then upper(usr) else usr end as usr,
    case when event_id % 3 = 1 then 'svc.exe' else 'svc' end as process, '1.0.0' as schema_version from ev"""
)
def normalize_severity(spark, sf_dir):
    return pipeline.normalized(spark, sf_dir).select("event_id", "severity", "ip_src", F.col("user").alias("usr"), "process", "schema_version")


@query(
    """with e as (select event_id, list_extract(['fim.baseline.created', 'fim.file.added', 'fim.file.removed', 'hash.mismatch', 'alert.created', 'other'], event_id % 6 + 1) as event_type, case when event_id % 4 = 0 then 'c-' || user_id end as c from events)
    select event_type, case when event_type like 'alert%' then 'alert' when event_type <> 'other' then 'file' end as category,
    case event_type when 'fim.baseline.created' then 'baseline_created' when 'fim.file.added' then 'created' when 'fim.file.removed' then 'deleted' when 'hash.mismatch' then 'hash_changed' when 'alert.created' then 'created' end as action,
    count(*) as n, count(distinct coalesce(c, cast(event_id as varchar))) as traces from e group by all"""
)
def sensor_normalize(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("fim.baseline.created", "fim.file.added", "fim.file.removed", "hash.mismatch", "alert.created", "other")])
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.element_at(kinds, (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("event_type"),
        F.when(F.pmod("event_id", F.lit(4)) == 0, F.concat(F.lit("c-"), F.col("user_id").cast("string"))).alias("correlation_id"),
    )
    return normalize.normalize_sensor(e).groupBy("event_type", "category", "action").agg(F.count("*").alias("n"), F.count_distinct("trace_id").alias("traces"))


# ---- rule conditions


def _dsl(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Every event with the verdict of each condition."""
    return df.select("event_id", *[c.alias(name) for name, c in conditions.items()])


_DSL = f"""with {sql.EV}, d as (select *, case when event_id % 7 = 0 then null else {_CLASSIFY} end as severity from ev)"""


def _dsl_events(spark, sf_dir):
    e = pipeline.events(spark, sf_dir)
    return e.withColumn("severity", F.when(F.pmod("event_id", F.lit(7)) != 0, normalize.classify(F.col("category"), F.col("action"), F.col("confidence"))))


@query(f"{_DSL} select event_id, coalesce((severity = 'high'), false) as eq, coalesce((severity is null or severity <> 'high'), false) as neq, coalesce((value = 5), false) as eq_number, false as eq_kind, true as neq_kind from d")
def dsl_eq_neq_null(spark, sf_dir):
    d = _dsl_events(spark, sf_dir)
    of = lambda f, op, v: dsl.leaf(d, f, op, v)
    return _dsl(d, {"eq": of("severity", "==", "high"), "neq": of("severity", "!=", "high"), "eq_number": of("value", "==", 5), "eq_kind": of("value", "==", "5"), "neq_kind": of("value", "!=", "5")})


@query(f"{_DSL} select event_id, coalesce((severity in ('high', 'critical')), false) as gte, coalesce((severity in ('info', 'low')), false) as lt, coalesce((value > 100), false) as gt_number, false as gt_kind from d")
def dsl_ordinal_severity(spark, sf_dir):
    d = _dsl_events(spark, sf_dir)
    of = lambda f, op, v: dsl.leaf(d, f, op, v)
    return _dsl(d, {"gte": of("severity", ">=", "HIGH"), "lt": of("severity", "<", "medium"), "gt_number": of("value", ">", 100), "gt_kind": of("value", ">", "100")})


@query(f"{_DSL} select event_id, coalesce((contains(source_host, '-1')), false) as contains, coalesce((category in ('auth', 'network')), false) as member, false as no_list, coalesce((regexp_matches(source_host, '-1[0-9]$')), false) as matches, false as bad_regex, coalesce((regexp_matches(cast(user_id as varchar), '^4')), false) as on_number from d")
def dsl_contains_in_matches(spark, sf_dir):
    d = _dsl_events(spark, sf_dir)
    of = lambda f, op, v: dsl.leaf(d, f, op, v)
    return _dsl(
        d,
        {
            "contains": of("source_host", "contains", "-1"), "member": of("category", "in", ["auth", "network"]), "no_list": of("category", "in", "auth"),
            "matches": of("source_host", "matches", "-1[0-9]$"), "bad_regex": of("source_host", "matches", "("), "on_number": of("user_id", "matches", "^4"),
        },
    )


@query(f"{_DSL} select event_id, coalesce((severity = 'high' and value > 50), false) as both_, coalesce((coalesce(severity = 'high', false) or value > 50), false) as either, coalesce((not coalesce(severity = 'high', false)), false) as neither, false as nothing from d")
def dsl_bool_tree(spark, sf_dir):
    d = _dsl_events(spark, sf_dir)
    a, b = dsl.leaf(d, "severity", "==", "high"), dsl.leaf(d, "value", ">", 50)
    return _dsl(d, {"both_": dsl.tree("and", [a, b]), "either": dsl.tree("or", [a, b]), "neither": dsl.tree("not", [a]), "nothing": dsl.tree("and", [])})


@query(f"{_DSL} select event_id, coalesce((category = 'auth' and severity in ('high', 'critical')), false) as plain, coalesce((not (category = 'auth')), false) as negated, coalesce((category = 'auth' and value > 10 and action = 'reject'), false) as mixed, coalesce((category = 'auth' or value >= 400.5), false) as either from d")
def dsl_parsed_text(spark, sf_dir):
    d = _dsl_events(spark, sf_dir)
    texts = {
        "plain": 'WHEN event.category == "auth" AND event.severity >= HIGH THEN raise_alert()',
        "negated": "when NOT category == auth then raise_alert()",
        "mixed": 'WHEN category == auth AND value > 10 OR action == "reject" THEN raise_alert()',
        "either": "WHEN category == auth OR event.value >= 400.5 THEN raise_alert()",
    }
    return _dsl(d, {k: dsl.condition(d, t) for k, t in texts.items()})


@query(f"with {sql.EV}, g as (select *, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then usr end as u from ev) select category, count(*) as n, count(*) filter (u <> '' and ip_src <> '') as gated, count(*) filter (category in ('auth', 'network')) as routed from g group by category")
def rule_gating(spark, sf_dir):
    e = pipeline.events(spark, sf_dir).withColumn("user", F.when(F.pmod("event_id", F.lit(3)) == 0, "").when(F.pmod("event_id", F.lit(3)) == 1, F.col("user")))
    return e.groupBy("category").agg(F.count("*").alias("n"), F.count_if(rules.present(e, ("user", "ip_src"))).alias("gated"), F.count_if(F.col("category").isin("auth", "network")).alias("routed"))


@query(f"with {sql.FOUND} select rule_id, severity, count(*) as findings, count(distinct source_host) as hosts, round(sum(confidence), 6) as confidence from found group by all")
def rule_findings(spark, sf_dir):
    return pipeline.findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.count_distinct("source_host").alias("hosts"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"with {sql.FOUND} select event_id, count(*) as findings, case max(srank) when 4 then 'critical' when 3 then 'high' else 'medium' end as severity, string_agg(distinct rule_id, ',' order by rule_id) as rules from found group by event_id")
def outcome_summary(spark, sf_dir):
    return rules.outcomes(pipeline.findings(spark, sf_dir)).withColumn("rules", F.array_join("rules", ","))


@query(f"with {sql.FOUND}, m as (select event_id, count(*) as n from found group by event_id) select coalesce(m.n, 0) as matches, count(*) as events from ev left join m using (event_id) group by 1")
def correlated_events(spark, sf_dir):
    c = rules.correlated(pipeline.events(spark, sf_dir).select("event_id"), pipeline.findings(spark, sf_dir))
    return c.groupBy(F.size("matches").cast("long").alias("matches")).agg(F.count("*").alias("events"))


_SIM = [
    {"rule_id": "brute", "category": "auth", "severity": "critical", "tags": ["reject"], "enabled": True},
    {"rule_id": "exec", "category": "process", "severity": "high", "tags": [], "enabled": True},
    {"rule_id": "host-1", "category": "", "severity": "odd", "tags": ["host-12"], "enabled": True},
    {"rule_id": "off", "category": "auth", "severity": "low", "tags": [], "enabled": False},
]


@query(
    f"""with {sql.EV}, t as (select event_id, category || ' ' || action || ' ' || source_host as t, source_host as r from ev), h as (
    select 'brute' as rule_id, case when t like '%reject%' then 'tag' when t like '%auth%' then 'category' when r like '%brute%' then 'rule_id' end as reason, 90 as score from t
    union all select 'exec', case when t like '%process%' then 'category' when r like '%exec%' then 'rule_id' end, 75 from t
    union all select 'host-1', case when t like '%host-12%' then 'tag' when r like '%host-1%' then 'rule_id' end, 50 from t)
    select rule_id, reason, score, count(*) as n from h where reason is not null group by all"""
)
def rule_simulator(spark, sf_dir):
    e = pipeline.events(spark, sf_dir).select("event_id", F.concat_ws(" ", "category", "action", "source_host").alias("text"), F.col("source_host").alias("payload_rule"))
    return rules.simulate(e, _SIM).groupBy("rule_id", "reason", "score").agg(F.count("*").alias("n"))


# ---- windows


@query(f"with {sql.EV}, w as (select event_id, ip_src, count(*) over (partition by ip_src order by ts range between interval 24 hours preceding and current row) as window_count from ev) select * from w where window_count >= 5")
def threshold_by_ip(spark, sf_dir):
    return windows.threshold_by_ip(pipeline.events(spark, sf_dir), 5, 24 * 3600).select("event_id", "ip_src", "window_count")


@query(f"with {sql.EV}, {sql.LOGIN} select event_id, source_host, n as window_count from login_f where n > 3")
def login_failures(spark, sf_dir):
    return windows.login_failures(pipeline.events(spark, sf_dir), 3, 72 * 3600).select("event_id", "source_host", "window_count")


@query(
    f"""with {sql.EV}, w as (select event_id, source_host, list(event_id) over (partition by source_host order by ts range between interval 12 hours preceding and current row) as ids from ev where category = 'auth')
    select event_id, len(ids) as n, array_to_string(ids, ',') as ids from w where len(ids) >= 2"""
)
def window_event_ids(spark, sf_dir):
    e = pipeline.events(spark, sf_dir).where(F.col("category") == "auth")
    w = e.withColumn("ids", windows.window_ids(["source_host"], "ts", "event_id", 12 * 3600))
    return w.where(F.size("ids") >= 2).select("event_id", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    f"""with {sql.EV}, g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from ev),
    s as (select *, sum(new) over (partition by user_id order by ts) as session from g)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as events from s group by user_id, session"""
)
def sessions(spark, sf_dir):
    return windows.sessions(pipeline.events(spark, sf_dir), ["user_id"], "6 hours").select("user_id", text_ts("start"), "events")


@query(
    f"""with recursive {sql.EV}, a as (select source_host as key, event_id as id, epoch_us(ts) / 1e6::double as t, row_number() over (partition by source_host order by ts, event_id) as k from ev), f as (
    select key, id, k, true as allowed, [t] as held from a where k = 1
    union all select a.key, a.id, a.k, len(list_filter(f.held, lambda x: x > a.t - 86400)) < 4,
      case when len(list_filter(f.held, lambda x: x > a.t - 86400)) < 4 then list_append(list_filter(f.held, lambda x: x > a.t - 86400), a.t) else list_filter(f.held, lambda x: x > a.t - 86400) end
    from f join a on a.key = f.key and a.k = f.k + 1) select key, id, allowed from f"""
)
def rate_limit_fold(spark, sf_dir):
    return windows.sliding_limit(pipeline.events(spark, sf_dir), "source_host", 4, 24 * 3600)


@query(
    f"""with recursive {sql.EV}, a as (select source_host as key, event_id as id, epoch_us(ts) / 1e6::double as t, row_number() over (partition by source_host order by ts, event_id) as k from ev), f as (
    select key, id, k, t, true as allowed, 1.0::double as tokens from a where k = 1
    union all select a.key, a.id, a.k, a.t, least(2.0::double, f.tokens + (a.t - f.t) * (1.0::double / 36000)) >= 1,
      least(2.0::double, f.tokens + (a.t - f.t) * (1.0::double / 36000)) - case when least(2.0::double, f.tokens + (a.t - f.t) * (1.0::double / 36000)) >= 1 then 1 else 0 end
    from f join a on a.key = f.key and a.k = f.k + 1) select key, id, allowed from f"""
)
def token_bucket(spark, sf_dir):
    return windows.token_bucket(pipeline.events(spark, sf_dir), "source_host", 1 / 36_000, 2)


@query(
    f"""with {sql.EV}, s as (select event_type as collector, event_id, ts, value * 40 as size from ev), m as (select *, case when size >= 8000 then true when size <= 2000 then false end as mark from s),
    p as (select *, coalesce(last_value(mark ignore nulls) over (partition by collector order by ts rows between unbounded preceding and current row), false) as paused from m)
    select collector, count(*) as n, count(*) filter (paused) as paused from p group by collector"""
)
def backpressure(spark, sf_dir):
    s = pipeline.events(spark, sf_dir).select(F.col("event_type").alias("collector"), "ts", (F.col("value") * 40).alias("size"))
    return windows.backpressure(s).groupBy("collector").agg(F.count("*").alias("n"), F.count_if("paused").alias("paused"))


@query("with a as (select distinct l_linenumber as attempt from lineitem) select attempt, least(20.0, 0.5 * pow(2.0, attempt - 1))::double as delay from a")
def retry_delays(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().withColumn("delay", windows.retry_delay(F.col("attempt"), 0.5, 20.0))


# ---- alerts, incidents, cases


@query(f"with {sql.ALERTS} select event_id, rule_id, fingerprint from al")
def alert_fingerprint(spark, sf_dir):
    return pipeline.alert_rows(spark, sf_dir).select("event_id", "rule_id", "fingerprint")


@query(f"with {sql.ALERTS} select rule_id, severity, risk, priority, count(*) as n from al group by all")
def alert_build_priority(spark, sf_dir):
    return pipeline.alert_rows(spark, sf_dir).groupBy("rule_id", "severity", "risk", "priority").agg(F.count("*").alias("n"))


@query(f"with {sql.DEDUP} select fingerprint, rule_id, event_id, severity, risk, priority, occurrences, {sql.ts('first_seen')} as first_seen, {sql.ts('last_seen')} as last_seen from dd")
def alert_dedup(spark, sf_dir):
    return pipeline.deduplicated(spark, sf_dir).select("fingerprint", "rule_id", "event_id", "severity", "risk", "priority", "occurrences", text_ts("first_seen"), text_ts("last_seen"))


def alerts_by_risk(spark, sf_dir):
    """The flagship: alerts of all rules, most at risk first."""
    return alert_dedup(spark, sf_dir).orderBy(F.desc("risk"), F.desc("occurrences"), "fingerprint")


@query(f"with {sql.ALERTS}, o as (select row_number() over (partition by fingerprint order by ts, event_id) as k from al) select case when k = 1 then 'created' else 'deduplicated' end as outcome, count(*) as n from o group by 1")
def alert_occurrences(spark, sf_dir):
    a = pipeline.alert_rows(spark, sf_dir).withColumn("k", alerts.occurrence())
    return a.groupBy(F.when(F.col("k") == 1, "created").otherwise("deduplicated").alias("outcome")).agg(F.count("*").alias("n"))


@query(
    f"""with {sql.EV}, c as (select c_custkey, c_acctbal from customer), r as (
    select event_id, 3 as srank, confidence, greatest(0.0, least(1.0, coalesce(c_acctbal, 0) / 10000.0 * 100.0 / 100.0)) as asset, case when user_id % 10 = 0 then 1.0 else 0.0 end as intel from ev left join c on c_custkey = user_id)
    select event_id, cast(round_even((3.0::double * srank / 4.0::double + confidence + 2.0::double * asset + 2.5::double * intel) / 8.5::double * 100.0::double, 0) as integer) as risk from r"""
)
def risk_score(spark, sf_dir):
    e = pipeline.events(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("user_id") == F.col("c_custkey"), "left")
    asset = severity.asset_factor(F.coalesce("c_acctbal", F.lit(0.0)) / 10000.0 * 100.0)
    intel = severity.intel_factor(F.when(F.pmod("user_id", F.lit(10)) == 0, 1.0).otherwise(0.0))
    return e.select("event_id", severity.risk(F.lit("high"), F.col("confidence"), [asset, intel]).alias("risk"))


@query(f"with {sql.INCIDENTS} select asset_id, alerts, score, severity, risk, round(mean_confidence, 3) as confidence, {sql.ts('first_seen')} as first_seen, {sql.ts('last_seen')} as last_seen, rules, mitre from inc")
def incident_rollup(spark, sf_dir):
    return pipeline.incident_rows(spark, sf_dir).select(
        "asset_id", "alerts", "score", "severity", "risk", "confidence", text_ts("first_seen"), text_ts("last_seen"), F.array_join("rules", ",").alias("rules"), F.array_join("mitre", ",").alias("mitre")
    )


@query(
    f"""with {sql.INCIDENTS} select score, severity, {sql.PRIORITY.format('risk')} as priority, count(*) as n,
    count(*) filter (n_rules = 1) as single from inc group by all"""
)
def incident_group_score(spark, sf_dir):
    i = pipeline.incident_rows(spark, sf_dir)
    return i.groupBy("score", "severity", "priority").agg(F.count("*").alias("n"), F.count_if(F.size("rules") == 1).alias("single"))


@query(f"""with {sql.INCIDENTS} select 'case-' || substr(sha256('{{"asset":"' || asset_id || '"}}'), 1, 16) as case_id, severity, risk, alerts as n_alerts from inc""")
def cases_from_incidents(spark, sf_dir):
    return pipeline.case_rows(spark, sf_dir).select("case_id", "severity", "risk", F.size("alert_ids").cast("long").alias("n_alerts"))


@query(f"with {sql.DEDUP}, i as (select distinct ip_src from ev where user_id % 5 = 0), x as (select fingerprint, ip_src from dd where user_id % 10 = 0) select i.ip_src, count(x.fingerprint) as n from i left join x using (ip_src) group by 1")
def ioc_related(spark, sf_dir):
    values = pipeline.events(spark, sf_dir).where(F.pmod("user_id", F.lit(5)) == 0).select("ip_src").distinct()
    return relations.related_counts(values, "ip_src", pipeline.grouping_rows(spark, sf_dir), "ioc_ids", "alert_id")


@query(f"with {sql.INCIDENTS}, a as (select distinct source_host as asset from ev) select asset, count(inc.asset_id) as n from a left join inc on inc.asset_id = asset group by 1")
def asset_related(spark, sf_dir):
    values = pipeline.events(spark, sf_dir).select(F.col("source_host").alias("asset")).distinct()
    return relations.related_counts(values, "asset", pipeline.case_rows(spark, sf_dir), "assets", "case_id")


@query(
    f"""with {sql.INCIDENTS}, c as (select 'case-' || substr(sha256('{{"asset":"' || asset_id || '"}}'), 1, 16) as case_id, asset_id, severity, last_seen from inc),
    a as (select source_host, string_agg(rule_id, ',' order by rule_id) as related, count(*) as n from dd group by 1), t as (select source_host, count(*) as events from found group by 1)
    select case_id, related, n, t.events as trail, case when last_seen + case severity when 'critical' then interval 1 hour when 'high' then interval 4 hours else interval 24 hours end < timestamp '{NOW}' then 'overdue'
      when epoch_us(last_seen + case severity when 'critical' then interval 1 hour when 'high' then interval 4 hours else interval 24 hours end) - epoch_us(timestamp '{NOW}')
        <= 0.3 * 3600000000 * case severity when 'critical' then 1 when 'high' then 4 else 24 end then 'warning' else 'ok' end as sla_state
    from c join a on a.source_host = c.asset_id join t on t.source_host = c.asset_id"""
)
def case_investigation(spark, sf_dir):
    cases = pipeline.case_rows(spark, sf_dir).withColumn("closed_at", F.lit(None).cast("timestamp"))
    trail = pipeline.findings(spark, sf_dir).select(keys.incident_fingerprint({"asset_id": F.col("source_host")}).alias("correlation_id"), "ts", F.lit("detect").alias("stage"), "event_id")
    done = relations.investigations(cases, pipeline.grouping_rows(spark, sf_dir), trail, F.lit(NOW).cast("timestamp"))
    names = F.array_sort(F.transform("related_alerts", lambda a: a["rule_id"]))
    return done.select("case_id", F.array_join(names, ",").alias("related"), F.size("related_alerts").cast("long").alias("n"), F.size("trail").cast("long").alias("trail"), "sla_state")


@query(
    """with c as (select 'sensor-event:' || o_orderkey as incident_id, 'case-' || o_orderkey as case_id, o_orderstatus as status from orders where o_orderkey % 3 = 0)
    select e.event_type, count(*) as n, count(c.case_id) as cases, count(*) filter (c.status = 'F') as finished from events e left join c on c.incident_id = 'sensor-event:' || e.event_id group by 1"""
)
def sensor_cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    cases = o.select(F.concat(F.lit("sensor-event:"), F.col("o_orderkey").cast("string")).alias("incident_id"), F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderstatus").alias("status"))
    joined = relations.sensor_cases(table(spark, sf_dir, "events"), cases)
    return joined.groupBy("event_type").agg(F.count("*").alias("n"), F.count("case_id").alias("cases"), F.count_if(F.col("case_status") == "F").alias("finished"))


_LOG = """l as (select user_id as id, ts, event_id, case event_type when 'click' then 'triage' when 'view' then 'investigating' when 'purchase' then 'resolved' when 'signup' then 'open' else 'false_positive' end as status from events)"""


def _log(spark, sf_dir):
    kinds = {"click": "triage", "view": "investigating", "purchase": "resolved", "signup": "open", "error": "false_positive"}
    return pipeline.events(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", severity.lookup(F.col("event_type"), kinds).alias("status"))


@query(
    f"""with {_LOG}, b as (select *, coalesce(lag(status) over (partition by id order by ts, status), 'open') as before from l)
    select before, status, before = status or (before = 'open' and status in ('triage', 'false_positive')) or (before = 'triage' and status in ('investigating', 'resolved', 'false_positive'))
      or (before = 'investigating' and status in ('resolved', 'false_positive')) or (before in ('resolved', 'false_positive') and status = 'open') as valid, count(*) as n from b group by all"""
)
def invalid_transitions(spark, sf_dir):
    return alerts.audited(_log(spark, sf_dir), alerts.ALERT_STATES).groupBy("before", "status", "valid").agg(F.count("*").alias("n"))


@query(
    """with recursive l as (select user_id as id, row_number() over (partition by user_id order by ts, event_id) as k,
      case event_type when 'click' then 'triage' when 'view' then 'investigating' when 'purchase' then 'resolved' when 'signup' then 'open' else 'false_positive' end as status from events),
    r as (select distinct id, 0::bigint as k, 'open' as status, 0 as transitions, 0 as refused from l
      union all
      select l.id, l.k, case when ok then l.status else r.status end, r.transitions + case when ok and l.status <> r.status then 1 else 0 end, r.refused + case when ok then 0 else 1 end
      from r join l on l.id = r.id and l.k = r.k + 1, lateral (select r.status = l.status or (r.status = 'open' and l.status in ('triage', 'false_positive')) or (r.status = 'triage' and l.status in ('investigating', 'resolved', 'false_positive'))
        or (r.status = 'investigating' and l.status in ('resolved', 'false_positive')) or (r.status in ('resolved', 'false_positive') and l.status = 'open') as ok) o)
    select id, status, transitions, refused from r qualify row_number() over (partition by id order by k desc) = 1"""
)
def lifecycle_current_state(spark, sf_dir):
    return alerts.replayed(_log(spark, sf_dir), alerts.ALERT_STATES)


@query(
    f"""with recursive l as (select user_id as id, ts, row_number() over (partition by user_id order by ts, event_id) as k,
      case event_type when 'click' then 'triage' when 'view' then 'investigating' when 'purchase' then 'closed' when 'signup' then 'resolved' else 'reopened' end as status from events),
    may(a, b) as (values ('open', 'triage'), ('triage', 'investigating'), ('investigating', 'contained'), ('investigating', 'resolved'), ('contained', 'resolved'), ('contained', 'closed'),
      ('resolved', 'closed'), ('resolved', 'reopened'), ('closed', 'reopened'), ('reopened', 'investigating'), ('reopened', 'triage')),
    g as (select list(a || '>' || b) as pairs from may),
    r as (select distinct id, 0::bigint as k, 'open' as status, 0 as transitions, 0 as refused, null::timestamp as moved_at, null::timestamp as closed_at from l
      union all
      select l.id, l.k, case when moved then l.status else r.status end, r.transitions + moved::int, r.refused + (not moved and r.status <> l.status)::int, case when moved then l.ts else r.moved_at end,
        case when moved then case when l.status = 'closed' then l.ts end else r.closed_at end
      from r join l on l.id = r.id and l.k = r.k + 1, g, lateral (select list_contains(g.pairs, r.status || '>' || l.status) as moved) o)
    select id, status, transitions, refused, {sql.ts('moved_at')} as moved_at, {sql.ts('closed_at')} as closed_at from r qualify row_number() over (partition by id order by k desc) = 1"""
)
def incident_lifecycle(spark, sf_dir):
    """Incidents' logs by composition of their pieces, with the time of closing while closed."""
    kinds = {"click": "triage", "view": "investigating", "purchase": "closed", "signup": "resolved", "error": "reopened"}
    log = pipeline.events(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", severity.lookup(F.col("event_type"), kinds).alias("status"))
    return alerts.lifecycle(log, alerts.INCIDENT_STATES).withColumns({c: text_ts(c) for c in ("moved_at", "closed_at")})


@query(
    """with c as (select o_custkey as case_id, 'clerk-' || (o_orderkey % 9) as owner, o_orderdate as ts from orders where o_orderkey % 4 <> 0)
    select case_id, arg_min(owner, (ts, owner)) as owner from c group by 1"""
)
def case_claims(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.concat(F.lit("clerk-"), F.pmod("o_orderkey", F.lit(9)).cast("string"))).alias("owner"), F.col("o_orderdate").alias("ts")
    )
    return incidents.claims(log).select("case_id", "owner")


@query(f"with {sql.ALERTS} select rule_id, count(*) as fire_count, {sql.ts('max(ts)')} as last_fired from al group by 1 union all select 'silent', 0, null")
def rule_fire_counts(spark, sf_dir):
    names = spark.createDataFrame([(r, 0, None) for r in ("login-failures", "large-reject", "busy-source", "silent")], "rule_id string, fire_count long, last_fired timestamp")
    return alerts.with_fire_counts(names, pipeline.alert_rows(spark, sf_dir)).select("rule_id", "fire_count", text_ts("last_fired"))


# ---- service levels and dashboards

_SEV = "case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' else 'info' end"
_HOURS = "case left(o_orderpriority, 1) when '1' then 1 when '2' then 4 when '3' then 24 else 72 end"
_ORDERS_NOW = "1998-08-01 00:00:00"
_ORDERS = f"""o as (select o_orderkey as id, {_SEV} as severity, {_HOURS} as hours, o_orderdate as created, case when o_orderstatus = 'F' then o_orderdate + to_hours(cast(o_orderkey % 60 as integer)) end as closed, o_custkey, o_orderstatus from orders),
  s as (select *, created + to_hours(hours) as due from o),
  st as (select *, case when closed is not null then case when closed <= due then 'met' else 'missed' end when due < timestamp '{_ORDERS_NOW}' then 'overdue'
    when epoch_us(due) - epoch_us(timestamp '{_ORDERS_NOW}') <= 0.3 * 3600000000 * hours then 'warning' else 'ok' end as state from s)"""


def _orders(spark, sf_dir):
    level = severity.lookup(F.substring("o_orderpriority", 1, 1), {"1": "critical", "2": "high", "3": "medium", "4": "low"}, "info")
    created = F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), level.alias("severity"), created.alias("created_at"), "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") == "F", created + F.make_interval(hours=F.pmod("o_orderkey", F.lit(60)).cast("int"))).alias("closed_at"),
    )
    now = F.lit(_ORDERS_NOW).cast("timestamp")
    return o.withColumn("sla_state", sla.state(F.col("severity"), F.col("created_at"), F.col("closed_at"), now)).withColumn("deadline", sla.deadline(F.col("severity"), F.col("created_at")))


@query(f"with {_ORDERS} select id, severity, state as sla_state, {sql.ts('due')} as deadline, greatest(0.0, (epoch_us(due) - epoch_us(timestamp '{_ORDERS_NOW}')) / 1e6)::double as remaining from st")
def sla_state(spark, sf_dir):
    left = sla.remaining(F.col("severity"), F.col("created_at"), F.lit(_ORDERS_NOW).cast("timestamp"))
    return _orders(spark, sf_dir).select("id", "severity", "sla_state", text_ts("deadline"), left.alias("remaining"))


@query(f"with {_ORDERS} select severity, state as sla_state, count(*) as n from st group by all")
def sla_summary(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy("severity", "sla_state").agg(F.count("*").alias("n"))


@query(
    f"""with {_ORDERS}, v as (select event_id, case when value > 200 then 'critical' when value > 50 then 'high' else 'low' end as severity, case when value > 200 then 1 when value > 50 then 4 else 72 end as hours, ts from events where event_type = 'error'),
    w as (select *, ts + to_hours(hours) as due from v),
    q as (select 'incident-' || id as id, severity, state, due, created, cast(case when o_custkey % 3 <> 0 then o_custkey end as varchar) as owner from st
      union all select 'event-' || event_id, severity, case when due < timestamp '{_ORDERS_NOW}' then 'overdue' when epoch_us(due) - epoch_us(timestamp '{_ORDERS_NOW}') <= 0.3 * 3600000000 * hours then 'warning' else 'ok' end, due, ts, null from w),
    r as (select *, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as sev, case when state in ('overdue', 'missed') then 0 when state = 'warning' then 1 else 2 end as srank,
      case when severity = 'critical' then 0 when severity = 'high' then 1 when state in ('overdue', 'missed') then 2 when state = 'warning' then 3 when owner is null then 4 else 5 end as band from q)
    select id, band, row_number() over (order by band, srank, due nulls last, sev desc, owner is not null, created desc, id) as place from r"""
)
def decision_queue(spark, sf_dir):
    """Orders are incidents, error events what sensors report."""
    incidents_ = _orders(spark, sf_dir).select(
        F.concat(F.lit("incident-"), F.col("id").cast("string")).alias("id"), "severity", "sla_state", "deadline", "created_at", F.when(F.pmod("o_custkey", F.lit(3)) != 0, F.col("o_custkey").cast("string")).alias("owner")
    )
    level = F.when(F.col("value") > 200, "critical").when(F.col("value") > 50, "high").otherwise("low")
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("id"), level.alias("severity"), F.col("ts").cast("timestamp").alias("created_at"))
    state = sla.state(F.col("severity"), F.col("created_at"), F.lit(None).cast("timestamp"), F.lit(_ORDERS_NOW).cast("timestamp"))
    sensors = e.withColumns({"sla_state": state, "deadline": sla.deadline(F.col("severity"), F.col("created_at"))})
    return kpi.placed(kpi.queue_sources(incidents_, sensors, incidents_.limit(0))).select("id", "band", "place")


@query(f"with {sql.DEDUP} select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from dd")
def severity_counts(spark, sf_dir):
    return kpi.severity_counts(pipeline.deduplicated(spark, sf_dir))


@query(f"with {sql.DEDUP} select count(*) as active_alerts, count(*) filter (severity = 'critical') as critical_alerts, cast(coalesce(round_even(avg(risk), 0), 0) as integer) as avg_risk from dd")
def kpi_block(spark, sf_dir):
    return kpi.alert_block(pipeline.deduplicated(spark, sf_dir))


@query(f"with {_ORDERS} select count(*) filter (o_orderstatus <> 'F') as open_cases, count(closed) as closed_cases, cast(floor(coalesce(avg((epoch_us(closed) - epoch_us(created)) / 1e6), 0)) as bigint) as mttr from st")
def mttr(spark, sf_dir):
    return kpi.case_block(_orders(spark, sf_dir).withColumn("status", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")))


@query(
    f"""with {sql.EV}, m as (select unnest(generate_series(timestamp '{NOW}' - interval 59 minutes, timestamp '{NOW}', interval 1 minute)) as minute),
    c as (select date_trunc('minute', ts) as minute, count(*) as n from ev where ts between timestamp '{NOW}' - interval 59 minutes and timestamp '{NOW}' group by 1)
    select {sql.ts('minute')} as minute, coalesce(n, 0) as events from m left join c using (minute)"""
)
def minute_series_zero_filled(spark, sf_dir):
    return kpi.minute_series(pipeline.events(spark, sf_dir), NOW).select(text_ts("minute"), "events")


@query(
    f"""with {sql.EV} select count(*) as total, count(*) filter (ts >= timestamp '{NOW}' - interval 1 day and ts <= timestamp '{NOW}') as last_24h,
    round_even(count(*) filter (ts >= timestamp '{NOW}' - interval 4 minutes and ts <= timestamp '{NOW}') / 300.0::double, 2) as eps from ev"""
)
def event_rates(spark, sf_dir):
    return kpi.event_rates(pipeline.events(spark, sf_dir), NOW)


def _top(value: str) -> str:
    return f"select {value} as value, count(*) as count from al group by 1 order by 2 desc, min(ts), 1 limit 10"


@query(f"with {sql.ALERTS} {_top('rule_id')}")
def top_rules(spark, sf_dir):
    return kpi.top(pipeline.alert_rows(spark, sf_dir), F.col("rule_id"))


@query(f"with {sql.ALERTS} {_top('tag')}")
def top_mitre(spark, sf_dir):
    return kpi.top(pipeline.alert_rows(spark, sf_dir), F.explode("tags"))


@query(f"with {sql.ALERTS} {_top('ip_src')}")
def top_iocs(spark, sf_dir):
    return kpi.top(pipeline.alert_rows(spark, sf_dir), F.col("ip_src"))


@query(f"with {sql.EV} select count(*) as total, count(*) filter (event_id % 4 = 0) as pending, {sql.ts('max(ts)')} as last_received, {sql.ts('min(case when event_id % 4 = 0 then ts end)')} as oldest_pending from ev")
def inbox_health(spark, sf_dir):
    inbox = pipeline.events(spark, sf_dir).select(F.when(F.pmod("event_id", F.lit(4)) == 0, "pending").otherwise("done").alias("status"), F.col("ts").alias("received_at"))
    return kpi.inbox_health(inbox).select("total", "pending", text_ts("last_received"), text_ts("oldest_pending"))


@query(f"with {sql.EV} select event_type as name, case event_type when 'click' then 'counter' when 'view' then 'gauge' else 'timer' end as kind, round(case event_type when 'click' then sum(value) when 'view' then arg_max(value, ts) else avg(value) end, 6) as value from ev group by event_type")
def metrics_timers(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "counter").when(F.col("event_type") == "view", "gauge").otherwise("timer")
    return kpi.metrics(pipeline.events(spark, sf_dir).select(F.col("event_type").alias("name"), kind.alias("kind"), "ts", "value"))


@query(f"with {sql.EV} select event_type as rule_id, count(*) as executions, count(*) filter (value > 50) as detections, count(*) filter (event_id % 11 = 0) as failures, round(avg(value), 6) as mean_seconds from ev group by 1")
def rule_metrics(spark, sf_dir):
    e = pipeline.events(spark, sf_dir)
    return kpi.rule_metrics(e.select(F.col("event_type").alias("rule_id"), (F.col("value") > 50).alias("detected"), (F.pmod("event_id", F.lit(11)) == 0).alias("failed"), F.col("value").alias("seconds")))


@query("select case max(case when s_acctbal < 0 then 2 when s_acctbal < 1000 then 1 else 0 end) when 2 then 'offline' when 1 then 'degraded' else 'online' end as health from supplier")
def worst_health(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return kpi.worst_health(s.select(F.when(F.col("s_acctbal") < 0, "offline").when(F.col("s_acctbal") < 1000, "degraded").otherwise("online").alias("health")))


# ---- search


@query(f"with {sql.DEDUP} select fingerprint, rule_id, risk from dd where risk >= 60 and rule_id <> 'busy-source' and source_host ilike '%HOST-1%' order by risk desc, fingerprint limit 25 offset 5")
def filter_ops_paged(spark, sf_dir):
    a = pipeline.deduplicated(spark, sf_dir)
    hits = search.where_all(a, [search.Filter("risk", "gte", 60), search.Filter("rule_id", "neq", "busy-source"), search.Filter("source_host", "contains", "HOST-1")])
    return search.page(hits, "risk", 25, 5, tie="fingerprint").select("fingerprint", "rule_id", "risk")


@query(f"with {sql.DEDUP} select count(*) as total, 30 < count(*) as has_more from dd where severity = 'high'")
def page_totals(spark, sf_dir):
    return search.page_info(search.where_all(pipeline.deduplicated(spark, sf_dir), [search.Filter("severity", "eq", "high")]), 25, 5)


@query(f"with {sql.DEDUP} select fingerprint as alert_id, rule_id, severity from dd where 'Detection: ' || rule_id ilike '%login%' and user_id % 10 = 0 and ip_src ilike '%10.0%' and tag ilike '%t1110%'")
def search_alerts(spark, sf_dir):
    found = search.search_alerts(pipeline.grouping_rows(spark, sf_dir), "login", ioc="10.0", mitre="t1110", status="open")
    return found.select("alert_id", "rule_id", "severity")


@query(
    f"""with {sql.INCIDENTS} select 'alert' as entity, rule_id as label, severity, count(*) as n from dd where source_host ilike '%-1%' group by all
    union all select 'incident', rules, severity, count(*) from inc where asset_id ilike '%-1%' group by all"""
)
def search_multi_entity(spark, sf_dir):
    a = search.search_entities(pipeline.grouping_rows(spark, sf_dir).withColumn("label", F.col("rule_id")).withColumn("assets", F.array("asset_id")), sets={"assets": "-1"})
    i = search.search_entities(pipeline.incident_rows(spark, sf_dir).withColumn("label", F.array_join("rules", ",")), sets={"assets": "-1"})
    return search.search_all({"alert": a, "incident": i}, ["label", "severity"]).groupBy("entity", "label", "severity").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderstatus from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1996-03-31'")
def date_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("created_at", F.col("o_orderdate").cast("timestamp"))
    return search.date_range(o, "1996-01-01", "1996-03-31").select("o_orderkey", "o_orderstatus")


@query(f"with {sql.DEDUP} select rule_id, severity, count(*) as n from dd where lower(concat_ws(' ', 'Detection: ' || rule_id, source_host, usr)) like '%user-2%' and severity = 'high' group by all")
def console_grid(spark, sf_dir):
    a = pipeline.deduplicated(spark, sf_dir)
    return search.grid(a, "USER-2", ["title", "source_host", "user"], severity="high", status="all").groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("select distinct source from documents where source is not null")
def facet_distinct(spark, sf_dir):
    return search.facets(table(spark, sf_dir, "documents"), "source")


@query(
    """select l_orderkey as id, l_linenumber as version, l_returnflag as status from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber desc, l_shipdate desc, l_partkey desc) = 1"""
)
def latest_versions(spark, sf_dir):
    rows = search.latest_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_shipdate", "l_partkey"])
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version"), F.col("l_returnflag").alias("status"))


# ---- validation and ingestion


_TEXTS = [  # text, is_ipv4, is_ipv6, is_hash, is_email, is_url, is_hostname, is_uuid, as the inventory describes the validators
    ("10.0.0.1", 1, 0, 0, 0, 0, 1, 0), (" 10.0.0.1 ", 1, 0, 0, 0, 0, 1, 0), ("10.0.0.256", 0, 0, 0, 0, 0, 1, 0), ("10.00.0.1", 0, 0, 0, 0, 0, 1, 0), ("10.0.0", 0, 0, 0, 0, 0, 1, 0),
    ("::1", 0, 1, 0, 0, 0, 0, 0), ("::", 0, 1, 0, 0, 0, 0, 0), ("2001:db8::ff00:42:8329", 0, 1, 0, 0, 0, 0, 0), ("::ffff:10.0.0.1", 0, 1, 0, 0, 0, 0, 0), ("1:2:3:4:5:6:7.8.9.10", 0, 1, 0, 0, 0, 0, 0),
    ("fe80::1%eth0", 0, 1, 0, 0, 0, 0, 0), ("1::2::3", 0, 0, 0, 0, 0, 0, 0), ("12345::", 0, 0, 0, 0, 0, 0, 0), ("::ffff:10.0.0.256", 0, 0, 0, 0, 0, 0, 0), ("1:2:3:4:5:6:7:8:9", 0, 0, 0, 0, 0, 0, 0),
    ("d41d8cd98f00b204e9800998ecf8427e", 0, 0, 1, 0, 0, 1, 1), ("D41D8CD98F00B204E9800998ECF8427E01", 0, 0, 1, 0, 0, 1, 0), ("d41d8cd98f00b204e9800998ecf8427", 0, 0, 0, 0, 0, 1, 0), ("x41d8cd98f00b204e9800998ecf8427e", 0, 0, 0, 0, 0, 1, 0),
    ("a@b.c", 0, 0, 0, 1, 0, 0, 0), (" a@b.c ", 0, 0, 0, 1, 0, 0, 0), ("a@b", 0, 0, 0, 0, 0, 0, 0), ("a b@c.d", 0, 0, 0, 0, 0, 0, 0),
    ("ftp://h/x", 0, 0, 0, 0, 1, 0, 0), ("git+ssh://h", 0, 0, 0, 0, 1, 0, 0), ("http://", 0, 0, 0, 0, 0, 0, 0), ("1http://h", 0, 0, 0, 0, 0, 0, 0), ("http://a b", 0, 0, 0, 0, 0, 0, 0),
    ("web-01.example", 0, 0, 0, 0, 0, 1, 0), ("-web", 0, 0, 0, 0, 0, 0, 0), ("a", 0, 0, 0, 0, 0, 1, 0), ("a..b", 0, 0, 0, 0, 0, 1, 0), ("under_score", 0, 0, 0, 0, 0, 0, 0), ("", 0, 0, 0, 0, 0, 0, 0),
    ("12345678-1234-1234-1234-123456789abc", 0, 0, 0, 0, 0, 1, 1), ("{12345678-1234-4123-8123-123456789ABC}", 0, 0, 0, 0, 0, 0, 1), ("urn:uuid:12345678-1234-4123-8123-123456789abc", 0, 0, 0, 0, 0, 0, 1), ("12345678-1234-4123-8123-123456789ab", 0, 0, 0, 0, 0, 1, 0),
]
_TESTS = {"is_ipv4": checks.is_ipv4, "is_ipv6": checks.is_ipv6, "is_hash": checks.is_hash, "is_email": checks.is_email, "is_url": checks.is_url, "is_hostname": checks.is_hostname, "is_uuid": checks.is_uuid}
_EXPECTED = "[" + ", ".join("'%s'" % "".join(map(str, t[1:])) for t in _TEXTS) + "]"


@query(f"""select page_id, {", ".join(f"list_extract({_EXPECTED}, page_id % {len(_TEXTS)} + 1)[{i + 1}] = '1' as {n}" for i, n in enumerate(_TESTS))} from pages""")
def validators(spark, sf_dir):
    """Texts whose verdicts are known, one a page."""
    text = F.element_at(F.array(*[F.lit(t[0]) for t in _TEXTS]), (F.pmod("page_id", F.lit(len(_TEXTS))) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", text.alias("text"))
    return rows.select("page_id", *[test(F.col("text")).alias(n) for n, test in _TESTS.items()])


def _event_json(**changed) -> str:
    """A valid event of a modified file, @ID and @TS to be filled in; members are replaced by those of ``changed`` (dots as __), None takes one away."""
    event = {
        "event_id": "@ID", "schema_version": "1.0", "timestamp": "@TS", "sequence": 1, "source": {"product": "sensor", "product_version": "1.2.3", "instance_id": "11111111-1111-1111-8111-111111111111", "component": "fim"},
        "event_type": "fim.file.modified", "severity": "high", "asset": {"asset_id": "a-1", "hostname": "host 1", "ip": "10.0.0.1"},
        "evidence": {"file_path": "etc/passwd", "hash_algorithm": "md5", "previous_hash": "a" * 32, "current_hash": "b" * 32, "baseline_id": "b", "scan_id": "s", "baseline_status": "modified", "details": {"n": [1, {"m": 2.5}]}},
        "metadata": {"correlation_id": "c", "tags": ["t"], "x_a": 1},
    }
    for name, value in changed.items():
        *way, last = name.split("__")
        at = event
        for n in way:
            at = at[n]
        at.pop(last) if value is None else at.__setitem__(last, json.loads("null") if value == "NULL" else value)
    return json.dumps(event, ensure_ascii=False)


def _nested(depth: int, inner: object) -> object:
    return inner if not depth else {"k": _nested(depth - 1, inner)}


_BROKEN = [  # one thing changed in a valid event, and what the contract has against it
    ({}, ""), ({"asset__ip": "::ffff:10.0.0.1"}, ""), ({"asset__ip": "10.0.0.300"}, "invalid_ip"), ({"asset__ip": "NULL"}, "null_field"), ({"asset__asset_id": ""}, "invalid_asset"), ({"asset__asset_id": "a" * 256}, "invalid_asset"),
    ({"asset__hostname": 5}, "invalid_asset"), ({"asset__os": "o" * 255}, ""), ({"asset__more": 1}, "unknown_field"), ({"sequence": "5"}, "invalid_sequence"), ({"sequence": 5.7}, "invalid_sequence"), ({"sequence": 0}, "invalid_sequence"),
    ({"sequence": True}, "invalid_sequence"), ({"source__component": 5}, "invalid_source"), ({"source__component": None}, "invalid_source"), ({"source__component": "other"}, "invalid_source"), ({"source__product_version": "1.2"}, "invalid_source"),
    ({"source__product_version": "1.2.3-rc.1+b"}, ""), ({"source__product_version": "1.2.3-rc..1"}, "invalid_source"), ({"source__instance_id": "x"}, "invalid_source"), ({"event_id": "no-uuid"}, "invalid_event_id"), ({"event_id": None}, "invalid_event_id"),
    ({"schema_version": "2.0"}, "invalid_schema_version"), ({"schema_version": 1.0}, "invalid_schema_version"), ({"timestamp": "2024-01-01 00:00:00"}, "invalid_timestamp"), ({"timestamp": "2024-02-30T00:00:00Z"}, "invalid_timestamp"), ({"timestamp": "2999-01-01T00:00:00Z"}, "timestamp_in_future"),
    ({"event_type": "fim.other"}, "invalid_event_type"), ({"severity": "urgent"}, "invalid_severity"), ({"severity": "HIGH"}, "invalid_severity"), ({"more": 1}, "unknown_field"), ({"evidence__file_path": "/etc/passwd"}, "invalid_path"),
    ({"evidence__file_path": "a/../b"}, "invalid_path"), ({"evidence__file_path": "c:x"}, "invalid_path"), ({"evidence__file_path": "a//b"}, "invalid_path"), ({"evidence__file_path": "a\\b"}, "invalid_path"), ({"evidence__file_path": "a/..b"}, ""), ({"evidence__file_path": "p" * 4097}, "invalid_path"),
    ({"evidence__file_path": None}, "missing_evidence"), ({"evidence__scan_id": None}, "missing_evidence"), ({"evidence__scan_id": ""}, "invalid_evidence"), ({"evidence__file_size_bytes": -1}, "invalid_evidence"), ({"evidence__file_size_bytes": 0}, ""), ({"evidence__mtime": "2024-01-01T00:00:00.5Z"}, ""),
    ({"evidence__mtime": "yesterday"}, "invalid_evidence"), ({"evidence__mtime": "NULL"}, "null_field"), ({"evidence__current_hash": "abc"}, "invalid_hash"), ({"evidence__current_hash": "B" * 32}, "invalid_hash"), ({"evidence__current_hash": "a" * 32}, "hashes_equal"),
    ({"evidence__baseline_status": "added"}, "invalid_baseline_status"), ({"evidence__baseline_status": "odd"}, "invalid_evidence,invalid_baseline_status"), ({"evidence__details": None}, "invalid_details"), ({"evidence__details": []}, "invalid_details"), ({"evidence__details": {}}, ""),
    ({"evidence__details": {f"k{i}": i for i in range(32)}}, ""), ({"evidence__details": {f"k{i}": i for i in range(33)}}, "invalid_details"), ({"evidence__details": {f"k{i}": "v" * 1000 for i in range(17)}}, "invalid_details"), ({"evidence__details": {"k": "v" * 1024}}, ""),
    ({"evidence__details": {"k": "v" * 1025}}, "invalid_details"), ({"evidence__details": {"k": '"' * 1024}}, ""), ({"evidence__details": _nested(4, 1)}, ""), ({"evidence__details": _nested(4, {})}, ""), ({"evidence__details": _nested(5, 1)}, "invalid_details"), ({"evidence__details": {"k": "null [[[[[["}}, ""),
    ({"evidence__details": {"k": ["NULL", None]}}, "invalid_details"), ({"metadata": None}, "invalid_metadata"), ({"metadata": {}}, ""), ({"metadata__y": 1}, "invalid_metadata"), ({"metadata__x_a": "NULL"}, "invalid_metadata"), ({"metadata__rule_id": "r" * 1025}, "invalid_metadata"),
    ({"metadata__tags": [""]}, "invalid_tags"), ({"metadata__tags": ["t" * 65]}, "invalid_tags"), ({"metadata__tags": ["t"] * 33}, "invalid_tags"), ({"metadata__tags": [1]}, "invalid_tags"), ({"metadata__tags": "t"}, "invalid_tags"),
    ({"event_type": "fim.file.removed", "evidence__baseline_status": "removed"}, "forbidden_current_hash"), ({"event_type": "fim.file.removed", "evidence__baseline_status": "removed", "evidence__current_hash": None}, ""),
    ({"event_type": "hash.mismatch", "evidence__baseline_status": "not_applicable"}, ""), ({"event_type": "hash.mismatch", "evidence__baseline_status": "matched"}, "invalid_baseline_status"),
    ({"event_type": "fim.baseline.created", "evidence__baseline_status": "created", "evidence__details": {"file_count": 3}}, ""), ({"event_type": "fim.baseline.created", "evidence__baseline_status": "created"}, "invalid_counts"),
    ({"event_type": "fim.scan.completed", "evidence__details": {k: 0 for k in ("added", "modified", "removed", "unchanged", "ignored", "duration_ms")}}, ""), ({"event_type": "fim.scan.completed", "evidence__details": {k: -1 for k in ("added", "modified", "removed", "unchanged", "ignored", "duration_ms")}}, "invalid_counts"),
    ({"event_type": "alert.created", "metadata__alert_id": "a", "metadata__rule_id": "r", "evidence__details": {"title": "t", "description": "d"}}, ""), ({"event_type": "alert.created", "metadata__alert_id": "a", "evidence__details": {"title": "t", "description": "d"}}, "invalid_alert"),
    ({"event_id": "@ID\n"}, "invalid_event_id"), ({"timestamp": "@TS\n"}, "invalid_timestamp"), ({"timestamp": "0000-01-01T00:00:00Z"}, "invalid_timestamp"), ({"source__product_version": "1.2.3\n"}, "invalid_source"), ({"evidence__current_hash": "b" * 31 + "\n"}, "invalid_hash"),
    ({"evidence__file_path": "a/..\n"}, ""), ({"sequence": 10**40}, ""), ({"sequence": 1e40}, "invalid_sequence"),
    ({"event_type": "alert.updated", "metadata__alert_id": "a", "evidence__details": {"previous_status": "p", "current_status": ""}}, "invalid_alert"), ({"event_type": "alert.updated", "metadata__alert_id": "a", "evidence__details": {"previous_status": "p", "current_status": "c"}}, ""),
]


def _sensor_payloads(spark, sf_dir):
    """An event for each event, changed by the remainder of its id."""
    k = F.pmod(F.col("event_id"), F.lit(len(_BROKEN)))
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    uid = F.concat(F.substring(digest, 1, 8), F.lit("-0000-4000-8000-"), F.substring(digest, 9, 12))
    body = F.element_at(F.array(*[F.lit(_event_json(**c)) for c, _ in _BROKEN]), (k + 1).cast("int"))
    body = F.replace(F.replace(body, F.lit("@ID"), uid), F.lit("@TS"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return spread(pipeline.events(spark, sf_dir).select("event_id", "user_id", "ts")).withColumn("payload", body)


_CODES = "[" + ", ".join(f"'{code}'" for _, code in _BROKEN) + "]"
_RECEIPT = "case split_part({0}, ',', 1) when '' then null when 'invalid_schema_version' then 'unsupported_schema_version' when 'timestamp_in_future' then 'invalid_timestamp' when 'invalid_event_type' then 'invalid_event_type' when 'invalid_severity' then 'invalid_severity' when 'invalid_timestamp' then 'invalid_timestamp' when 'invalid_event_id' then 'invalid_event_id' else 'validation_error' end"


@query(f"with e as (select event_id, list_extract({_CODES}, event_id % {len(_BROKEN)} + 1) as errors from events) select event_id, errors, {_RECEIPT.format('errors')} as receipt_code from e")
def contract_errors(spark, sf_dir):
    sent = _sensor_payloads(spark, sf_dir).select("event_id", "payload")
    found = contract.with_errors(sent, "payload", F.lit("2025-01-01").cast("timestamp"), name="found")
    return found.select("event_id", F.array_join("found", ",").alias("errors"), contract.receipt_code(F.col("found")).alias("receipt_code"))


@query(
    """with b as (select event_id, event_id % 6 as k from events)
    select event_id as batch_no, list_extract(['', 'invalid_events', 'invalid_events', 'invalid_batch_id', 'invalid_sent_at', 'unknown_field'], k + 1) as errors from b"""
)
def batch_envelopes(spark, sf_dir):
    """Envelopes of no, one, a hundred and a hundred and one events."""
    k = F.pmod("event_id", F.lit(6))
    events = F.when(k == 1, F.lit("")).when(k == 2, F.array_join(F.array_repeat(F.lit("{}"), 101), ",")).otherwise(F.array_join(F.array_repeat(F.lit("{}"), 100), ","))
    uid = F.when(k == 3, F.lit("x")).otherwise(F.lit("12345678-1234-4123-8123-123456789abc"))
    sent = F.when(k == 4, F.lit("now")).otherwise(F.lit("2024-01-01T00:00:00Z"))
    more = F.when(k == 5, F.lit(',"more":1')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"batch_id":"'), uid, F.lit('","sent_at":"'), sent, F.lit('"'), more, F.lit(',"events":['), events, F.lit("]}"))
    rows = contract.batch_errors(table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_no"), text.alias("payload")))
    return rows.select("batch_no", F.array_join("batch_errors", ",").alias("errors"))


def _batch_rows(spark, sf_dir):
    """Batches of the events: every ninth is sent twice, every fifteenth of batch 7k twice with other content; every fourth is stored already."""
    e = pipeline.events(spark, sf_dir).select(F.floor(F.col("event_id") / 100).alias("batch_id"), F.col("event_id").alias("position"), F.col("source_host").alias("source_instance_id"), F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("content_hash"), F.col("value"))
    bad = F.when(F.col("value") < 3, F.array(F.lit("invalid"))).otherwise(F.array().cast("array<string>"))
    again = e.where("position % 9 = 0").withColumn("position", F.col("position") + 1_000_000)
    clash = e.where("position % 15 = 0 and batch_id % 7 = 0").withColumn("position", F.col("position") + 2_000_000).withColumn("content_hash", F.lit("other"))
    batch = e.union(again).union(clash).withColumn("errors", bad).drop("value")
    inbox = e.where("position % 4 = 0 and value >= 3").select("source_instance_id", "event_id", "content_hash")
    return contract.classify_batch(batch, inbox)


_BATCH = f"""{sql.EV}, e as (select event_id // 100 as batch_id, event_id as position, event_id as id, source_host, cast(value as varchar) as h, value from ev),
  b as (select * from e union all select batch_id, position + 1000000, id, source_host, h, value from e where position % 9 = 0
    union all select batch_id, position + 2000000, id, source_host, 'other', value from e where position % 15 = 0 and batch_id % 7 = 0),
  w as (select *, value >= 3 as good, first_value(h) over (partition by batch_id, id, value >= 3 order by position) as f, row_number() over (partition by batch_id, id, value >= 3 order by position) as n from b),
  j as (select *, case when id % 4 = 0 and value >= 3 then cast(value as varchar) when n > 1 then f end as known from w),
  a as (select *, case when not good then 'rejected' when known is null then 'accepted' when known = h then 'duplicate' else 'conflict' end as ack from j),
  c as (select *, bool_or(ack = 'conflict') over (partition by batch_id) as batch_conflict from a)"""


@query(f"with {_BATCH} select ack, batch_conflict, count(*) as n from c group by all")
def inbox_classify(spark, sf_dir):
    return _batch_rows(spark, sf_dir).groupBy("ack", "batch_conflict").agg(F.count("*").alias("n"))


@query(
    f"""with {_BATCH}, r as (select batch_id, count(*) filter (ack = 'accepted') as accepted, count(*) filter (ack = 'duplicate') as duplicate, count(*) filter (ack = 'rejected') as rejected, bool_or(batch_conflict) as aborted from c group by 1)
    select batch_id, accepted, duplicate, rejected, case when aborted then 'conflict' when accepted + duplicate > 0 then 'stored' else 'rejected' end as status from r"""
)
def batch_receipts(spark, sf_dir):
    return contract.receipts(_batch_rows(spark, sf_dir)).select("batch_id", "accepted", "duplicate", "rejected", "status")


@query(
    """with b as (select o_orderkey, case when o_orderkey % 3 = 0 then 'x' else 'y' end as h from orders), r as (select o_orderkey, case when o_orderkey % 2 = 0 then 'x' else 'y' end as h from orders where o_orderkey % 5 <> 0)
    select o_orderkey as batch_id, case when r.h is null then 'new' when r.h = b.h then 'replay' else 'conflict' end as state from b left join r using (o_orderkey)"""
)
def batch_replay(spark, sf_dir):
    """A batch an order; those whose key five does not divide came before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"))
    b = o.withColumn("content_hash", F.when(F.pmod("batch_id", F.lit(3)) == 0, "x").otherwise("y"))
    r = o.where("batch_id % 5 <> 0").withColumn("content_hash", F.when(F.pmod("batch_id", F.lit(2)) == 0, "x").otherwise("y"))
    return contract.replayed(b, r).select("batch_id", "state")


@query("select sha256('{\"a\":' || user_id || ',\"b\":\"' || event_type || '\"}') as content_hash, count(*) as n from events group by 1")
def canonical_hash(spark, sf_dir):
    text = F.concat(F.lit('{ "b": "'), "event_type", F.lit('", "a": '), F.col("user_id").cast("string"), F.lit(" }"))
    return table(spark, sf_dir, "events").select(keys.content_hash(text).alias("content_hash")).groupBy("content_hash").agg(F.count("*").alias("n"))


# ---- enrichment and stores


@query(
    f"""with {sql.EV}, g as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey)
    select e.event_id, (c.c_custkey is not null)::int + (c.c_custkey is not null and g.n_nationkey is not null)::int + (e.user_id % 10 = 0)::int + (c.c_custkey is not null)::int as n, c.c_name as name, c.c_mktsegment as segment, g.r_name as region, case when e.user_id % 10 = 0 then 'malicious' end as reputation
    from ev e left join customer c on c.c_custkey = e.user_id left join g on g.n_nationkey = c.c_nationkey"""
)
def enrich_asset_geo_intel_user(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    host, ip = F.concat(F.lit("host-"), F.col("c_custkey").cast("string")), F.concat(F.lit("10.0."), F.floor(F.col("c_custkey") / 256).cast("string"), F.lit("."), F.pmod("c_custkey", F.lit(256)).cast("string"))
    assets = c.select(host.alias("hostname"), F.col("c_mktsegment").alias("segment"))
    geo = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(ip.alias("ip"), F.col("r_name").alias("region"))
    people = c.select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("login"), F.col("c_name").alias("name"))
    e = pipeline.events(spark, sf_dir)
    intel = e.where(F.pmod("user_id", F.lit(10)) == 0).select(F.col("ip_src").alias("indicator"), F.lit("malicious").alias("reputation")).distinct()
    made = enrich.enrich(
        e,
        [
            enrich.Provider("asset", "inventory", assets, [("source_host", "hostname")], ["segment"]),
            enrich.Provider("geo", "geo", geo, [("ip_src", "ip")], ["region"]),
            enrich.Provider("intel", "feed", intel, [("ip_src", "indicator")], ["reputation"]),
            enrich.Provider("user", "directory", people, [("user", "login")], ["name"]),
        ],
    )
    of = lambda kind, name: F.get_json_object(F.get(F.filter("enrichments", lambda x: x["kind"] == kind), F.lit(0))["data"], f"$.{name}").alias(name)
    return made.select("event_id", F.size("enrichments").alias("n"), of("asset", "segment"), of("geo", "region"), of("intel", "reputation"), of("user", "name"))


@query(f"with {sql.EV} select ip_src as value, count(*) as hits, {sql.ts('min(ts)')} as first_seen, {sql.ts('max(ts)')} as last_seen, arg_min(event_type, ts) as ioc_type, arg_max(action, ts) as reputation from ev group by 1")
def ioc_upsert(spark, sf_dir):
    s = pipeline.events(spark, sf_dir).select(F.col("ip_src").alias("value"), F.col("event_type").alias("ioc_type"), F.col("action").alias("reputation"), "ts")
    return stores.iocs(s).select("value", "hits", text_ts("first_seen"), text_ts("last_seen"), "ioc_type", "reputation")


@query(f"with {sql.EV} select source_host as hostname, event_type as os_name, value as criticality from ev qualify row_number() over (partition by source_host order by ts desc, event_id desc) = 1")
def asset_upsert(spark, sf_dir):
    r = pipeline.events(spark, sf_dir).select(F.col("source_host").alias("hostname"), F.col("event_type").alias("os_name"), F.col("value").alias("criticality"), "ts", F.col("event_id").alias("registration_id"))
    return stores.assets(r).select("hostname", "os_name", "criticality")


@query(
    """with o as (select p_partkey as k, p_brand as severity, p_size as fires from part where p_partkey % 3 <> 0), n as (select p_partkey as k, p_type as severity from part where p_partkey % 2 = 0)
    select 'r-' || coalesce(o.k, n.k) as rule_id, coalesce(n.severity, o.severity) as severity, coalesce(fires, 0) as fire_count from o full join n on o.k = n.k"""
)
def rule_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("rule_id", F.concat(F.lit("r-"), F.col("p_partkey").cast("string")))
    old = p.where("p_partkey % 3 <> 0").select("rule_id", F.col("p_brand").alias("severity"), F.col("p_size").alias("fire_count"), F.lit(None).cast("timestamp").alias("last_fired"))
    return stores.upsert_rules(old, p.where("p_partkey % 2 = 0").select("rule_id", F.col("p_type").alias("severity"))).select("rule_id", "severity", "fire_count")


@query(f"with {sql.EV} select event_id as audit_id, event_type as action, source_host as entity from ev where source_host = 'host-8' and event_type = 'error' order by ts desc, event_id limit 50")
def audit_by_entity(spark, sf_dir):
    a = pipeline.events(spark, sf_dir).select(F.col("event_id").alias("audit_id"), F.col("event_type").alias("action"), F.col("source_host").alias("entity"), "ts")
    return stores.audit(a, entity="host-8", action="error", limit=50).select("audit_id", "action", "entity")


@query("with r as (select case user_id % 4 when 0 then 'get' when 1 then 'POST' when 2 then 'delete' else 'PATCH' end as method, 200 + (event_id % 3) * 150 as status from events) select upper(method) as method, case when status < 400 then 'success' else 'failure' end as outcome, count(*) as n from r where lower(method) <> 'get' group by all")
def access_audit(spark, sf_dir):
    methods = F.array(*[F.lit(m) for m in ("get", "POST", "delete", "PATCH")])
    r = table(spark, sf_dir, "events").select(F.element_at(methods, (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("method"), (F.pmod("event_id", F.lit(3)) * 150 + 200).alias("status"))
    return stores.access_audit(r).groupBy(F.upper("method").alias("method"), "outcome").agg(F.count("*").alias("n"))


# ---- streams


@query(f"with {sql.EV}, {sql.LOGIN} select source_host as key, event_id, n as window_count from login_f where n > 3")
def stream_threshold(spark, sf_dir):
    from loomwatch.plans import streams

    return streams.threshold(spark, sf_dir)


@query(f"with {sql.ALERTS} select fingerprint, event_id, row_number() over (partition by fingerprint order by ts, event_id) as occurrence from al where rule_id = 'large-reject'")
def stream_dedup(spark, sf_dir):
    from loomwatch.plans import streams

    return streams.dedup(spark, sf_dir)


_STREAM_ALERTS = f"""{sql.EV}, al as (
    select event_id, ts, epoch_us(ts) // 1000 as ms, source_host as key, user_id, rule, srank, round_even((3.0::double * srank / 4.0::double + confidence) / 4.0::double * 100.0::double, 0) as risk
    from (select *, case when category = 'network' then 'large-reject' else 'auth-reject' end as rule, case when category = 'network' then 4 else 3 end as srank from ev
      where (category = 'network' and value > 200) or (category = 'auth' and action = 'reject'))), wm as (select epoch_us(max(ts)) // 1000 - 3600000 as wm from al)"""


@query(
    f"""with {_STREAM_ALERTS}, b as (select *, case when ms - lag(ms) over (partition by key order by ts, event_id) >= 259200000 then 1 else 0 end as fresh from al),
    s as (select *, sum(fresh) over (partition by key order by ts, event_id) as session from b),
    k as (select *, row_number() over w as k, min(ts) over w as begun, max(srank) over w as top, cast(round_even(avg(risk) over w, 0) as integer) as mean,
        cast(round_even((60 + case when user_id % 10 = 0 then 25 else 0 end + case when min(rule) over w = max(rule) over w then 50 else 0 end + case when ts - min(ts) over w <= interval 1 hour then 10 else 0 end) * 100.0::double / 145.0::double, 0) as integer) as score
      from s window w as (partition by key, session order by ts, event_id)),
    o as (select *, min(case when k >= 2 and score >= 40 then k end) over (partition by key, session) as opens, max(ts) over (partition by key, session) as latest, max(k) over (partition by key, session) as n from k),
    told as (select o.*, f.top as held_top, f.mean as held_mean, f.score as held_score from o join o f on f.key = o.key and f.session = o.session and f.k = least(o.k, coalesce(o.opens, o.k))),
    done as (select key, event_id, case when opens is null or k < opens then 'no_group' when k = opens then 'new' else 'dedup' end as decision, {sql.ts('ts')} as told_at, greatest(0, k - coalesce(opens, k + 1) + 1) as occurrences,
        {sql.ts('begun')} as first_seen, {sql.ts('ts')} as last_seen, held_top, held_mean, held_score from told, wm where ms <= wm
      union all
      select key, null, 'ended', {sql.ts('make_timestamp((ms + 259200000) * 1000)')}, n - opens + 1, {sql.ts('begun')}, {sql.ts('latest')}, held_top, held_mean, held_score from told, wm where k = n and opens is not null and ms + 259200000 <= wm)
    select key, event_id, decision, told_at, occurrences, first_seen, last_seen, case held_top when 4 then 'critical' else 'high' end as severity, held_mean as risk, held_score as score from done"""
)
def stream_incidents(spark, sf_dir):
    """Alerts of a stream into incidents held as state: opened, deduplicated into the open one, ended by a timer."""
    from loomwatch.plans import streams

    return streams.incident_changes(spark, sf_dir).withColumns({c: text_ts(c) for c in ("told_at", "first_seen", "last_seen")})


@query(
    f"""with {sql.EV}, e as (select event_id, ts, epoch_us(ts) // 1000 as ms, source_host as key from ev where category = 'auth' and action = 'reject'), wm as (select epoch_us(max(ts)) // 1000 - 3600000 as wm from e),
    c as (select *, count(*) over (partition by key order by ms range between 172800000 preceding and current row) - (count(*) over (partition by key, ms) - row_number() over (partition by key, ms order by ts, event_id)) as n from e),
    m as (select *, max(case when n >= 3 then ms end) over (partition by key order by ms range between current row and 172800000 following) as later from c)
    select key, event_id, case when n >= 3 then 'match' else 'deferred' end as decision, {sql.ts('ts')} as told_at, n as window_count from m, wm where ms <= wm
    union all
    select key, event_id, case when later is not null then 'match' else 'no_match' end, {sql.ts('make_timestamp((ms + 172800000) * 1000)')}, null from m, wm where n < 3 and ms + 172800001 <= wm"""
)
def stream_decisions(spark, sf_dir):
    """A rule's match, no_match or deferred for each event; deferred ones are told again when their window closes."""
    from loomwatch.plans import streams

    return streams.decisions(spark, sf_dir).withColumn("told_at", text_ts("told_at"))


@query(
    f"""with e as (select event_id as k, event_id % 3 as i, event_id // 3 as g from events), v as (
      select *, (k % 17 <> 0) as valid, case when i = 2 and k % 5 = 0 then 'b' else 'a' end as h, case when k % 4 = 0 then 2 else 1 end as n, min(case when k % 17 <> 0 then k end) over (partition by g) as first from e),
    r as (select v.*, f.h as held from v left join v f on f.k = v.first),
    o as (select k, valid, n, g % 7 = 0 as bad, k = first as first_, h <> held as clash from r),
    s as (select *, case when bad then 'rejected' when clash then 'conflict' else 'stored' end as st from o),
    sent as (select *, 0 as again from s union all select *, 1 from s where k % 11 = 0 or k % 13 = 0),
    t as (select *, case when not valid then 'invalid' when again = 0 then 'new' when k % 13 = 0 or st = 'conflict' then 'conflict' else 'replay' end as state from sent),
    d as (select *, state in ('new', 'replay') and st <> 'conflict' as shown from t)
    select k * 2 + again as turn, state, case when not valid then 'invalid_batch_id' end as error, case when shown then case when bad or not first_ then 0 else 1 end end as accepted,
      case when shown then case when bad then 0 when first_ then n - 1 else n end end as duplicate, case when shown then case when bad then n else 0 end end as rejected,
      case when not valid then 'rejected' when state = 'conflict' then 'conflict' else st end as status from d"""
)
def stream_ingest(spark, sf_dir):
    """A batch for each event: three in a row send the same event, some with other content; some batches come again, some changed."""
    from loomwatch.plans import streams

    k = F.col("event_id")
    lot = F.floor(k / 3)
    uid = lambda of: F.concat(F.substring(F.sha2(of, 256), 1, 8), F.lit("-0000-4000-8000-"), F.substring(F.sha2(of, 256), 9, 12))
    event = F.replace(F.replace(F.lit(_event_json()), F.lit("@ID"), uid(F.concat(F.lit("e"), lot.cast("string")))), F.lit("@TS"), F.lit("2024-01-01T00:00:00Z"))
    event = F.when(F.pmod(lot, F.lit(7)) == 0, F.replace(event, F.lit('"high"'), F.lit('"urgent"'))).when((k % 3 == 2) & (k % 5 == 0), F.replace(event, F.lit('"sequence": 1'), F.lit('"sequence": 2'))).otherwise(event)
    batch = F.when(k % 17 == 0, F.lit("x")).otherwise(uid(F.concat(F.lit("b"), k.cast("string"))))
    again = F.explode(F.when((k % 11 == 0) | (k % 13 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    day = F.when((F.col("again") == 1) & (k % 13 == 0), "2").otherwise("1")
    text = F.concat(F.lit('{"batch_id":"'), batch, F.lit('","sent_at":"2024-01-0'), day, F.lit('T00:00:00Z","events":['), event, F.when(k % 4 == 0, F.concat(F.lit(","), event)).otherwise(""), F.lit("]}"))
    sent = table(spark, sf_dir, "events").select("event_id", again.alias("again")).withColumns({"turn": k * 2 + F.col("again"), "file": F.pmod(lot, F.lit(streams.FILES)).cast("int")})
    return streams.ingested(spark, sent, text).select("turn", "state", "error", "accepted", "duplicate", "rejected", "status")


# ---- indexed search, change feeds

_NEEDLES = ("Failed password for user-4", "host-12 sshd", "JOB of user-1%3", "no such text", "ob")


@query(
    f"""with {_LINES}, t as (select event_id, form, lower(message) as m, source_host, process from ln)
    select '{_NEEDLES[0]}' as needle, event_id from t where m like '%failed password for user-4%'
    union all select '{_NEEDLES[1]}', event_id from t where form < 4 and source_host = 'host-12' and process = 'sshd'
    union all select '{_NEEDLES[2]}', event_id from t where m like '%job of user-1%3%'
    union all select '{_NEEDLES[4]}', event_id from t where m like '%ob%'"""
)
def search_indexed(spark, sf_dir):
    """Raw lines that contain each of several texts, through a written trigram index."""
    from loomwatch.plans import streams

    held = textindex.TextIndex(streams.folder(spark, "text-index"), "event_id", "raw_payload")
    held.write(pipeline.lines(spark, sf_dir).select("event_id", "raw_payload"))
    found = [held.search(spark, n).select(F.lit(n).alias("needle"), "event_id") for n in _NEEDLES]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(
    """with b as (select o_orderkey as k, o_orderstatus as s, o_totalprice as p from orders where o_orderkey % 10 <> 0),
    a as (select o_orderkey as k, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end as s, case when o_orderkey % 4 = 0 then o_totalprice + 1 else o_totalprice end as p from orders where o_orderkey % 7 <> 0)
    select coalesce(a.k, b.k) as id, case when b.k is null then 'created' when a.k is null then 'deleted' when a.s is distinct from b.s then 'status_changed' else 'updated' end as change, b.s as from_status, a.s as to_status
    from a full join b on a.k = b.k where a.k is null or b.k is null or a.s is distinct from b.s or a.p is distinct from b.p"""
)
def change_feed(spark, sf_dir):
    """Two versions of the orders: some are new, some gone, some with another status or price."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    before, after = o.where("id % 10 <> 0"), o.where("id % 7 <> 0")
    after = after.withColumns({"status": F.when(F.col("id") % 6 == 0, "X").otherwise(F.col("status")), "price": F.when(F.col("id") % 4 == 0, F.col("price") + 1).otherwise(F.col("price"))})
    return changes.changes(before, after, "id")


@query(
    f"""with {sql.FOUND}, n as (select rule_id, count(*) as n from found group by 1), v(rule_id, applied) as (values ('login-failures', 'auth'), ('large-reject', 'network'), ('busy-source', null))
    select v.rule_id, (select count(*) from ev where v.applied is null or category = v.applied) as executions, coalesce(n.n, 0) as detections, null as failure from v left join n using (rule_id)
    union all select 'no-such-column', 0, 0, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'"""
)
def rule_run_metrics(spark, sf_dir):
    """What each rule of the registry was applied to and found, observed while the findings are made; a rule that does not fit is left out."""
    held = pipeline.registry()
    held.register(rules.Rule("no-such-column", F.col("nowhere") == 1, "low"))
    run = rules.measured(pipeline.events(spark, sf_dir), held.ordered(), [*pipeline.COLUMNS, "value"])
    run.found.write.format("noop").mode("overwrite").save()
    return run.metrics(spark)


# ---- collectors, plugins in SQL, attachments


@query(
    f"""with {_LINES} select coalesce(fmt, 'none') as fmt, case when fmt is not null then source_host end as host, case when fmt is not null then process end as process, case when fmt is not null then m end as message,
    case when fmt is null then message end as unparsed, count(*) as n from parsed group by all"""
)
def stream_collector(spark, sf_dir):
    """Log files through the collector's stream and the parsers."""
    from loomwatch.plans import streams

    p = syslog.parse(streams.collected(spark, pipeline.lines(spark, sf_dir)))
    return p.groupBy(
        F.coalesce("parsed.format", F.lit("none")).alias("fmt"), F.col("parsed.host").alias("host"), F.col("parsed.process").alias("process"), F.col("parsed.message").alias("message"),
        F.when(~F.col("parse_ok"), F.col("raw_payload")).alias("unparsed"),
    ).agg(F.count("*").alias("n"))


@query(
    f"""with {_LINES}, f as (select event_id, message, unnest(range(event_id % 3 + 1)) as position from ln)
    select event_id, cast(position as integer) as position, case when position = 0 then message else message || ' é' || position end as message, cast(null as varchar) as error from f where event_id % 13 <> 0"""
)
def plugin_frames(spark, sf_dir):
    """Frames of one to three messages, taken apart by a registered table function in a LATERAL join; every 13th event has no payload."""
    plugins.register_parsers(spark)
    n = F.col("event_id")
    word = F.when(F.col("action") == "reject", "Failed password for").when(F.col("action") == "accept", "Accepted login of").when(F.col("action") == "start", "Started job of").otherwise("Seen")
    message = F.concat_ws(" ", word, "user")
    counted = lambda m: F.concat(F.octet_length(m).cast("string"), F.lit(" "), m)
    more = F.transform(F.sequence(F.lit(0), (n % 3).cast("int")), lambda i: counted(F.when(i == 0, message).otherwise(F.concat(message, F.lit(" é"), i.cast("string")))))
    frames = pipeline.events(spark, sf_dir).select("event_id", F.when(n % 13 != 0, F.array_join(more, "")).alias("payload"))
    return spark.sql("SELECT r.event_id, p.position, p.message, p.error FROM {frames} r, LATERAL octet_counted(r.payload) p", frames=frames)


@query(
    """with l as (select event_id as id, user_id, cast(ts as date) as day, ts, case when event_id % 3 <> 0 then '  at ' || event_type else event_type || ' ' || event_id end as line, event_id % 3 = 0 as head from events),
    k as (select *, row_number() over w as place, sum(cast(head as integer)) over (partition by user_id, day order by ts, id rows unbounded preceding) as m from l window w as (partition by user_id, day order by ts, id))
    select min_by(id, place) as id, cast(count(*) as integer) as n_lines, string_agg(line, chr(10) order by place) as message from k group by user_id, day, m"""
)
def plugin_stitched(spark, sf_dir):
    """Messages of several lines, put together by a registered table function over a user's lines of a day."""
    plugins.register_stitched(spark)
    head = F.col("event_id") % 3 == 0
    line = F.when(head, F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("  at "), "event_type"))
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.to_date("ts").alias("day"), "ts", line.alias("line"))
    return spark.sql("SELECT * FROM stitched(TABLE(SELECT * FROM {lines}) PARTITION BY (user_id, day) ORDER BY (ts, id))", lines=lines)


@query(
    """with f as (select page_id, page_id % 40 as case_id, case when page_id % 9 = 0 then null when page_id % 5 = 0 then 'shared evidence ' || (page_id % 7) else html end as body from pages)
    select page_id, case_id, coalesce(octet_length(encode(body)), 0) as size, sha256(body) as sha256, case when body is null then 'link' else 'stored' end as state from f"""
)
def case_attachments(spark, sf_dir):
    """Pages as attachments of cases: stored by hash in two batches, one of them twice, and checked; every ninth is a link only."""
    from loomwatch.plans import streams

    n = F.col("page_id")
    body = F.when(n % 9 != 0, F.when(n % 5 == 0, F.concat(F.lit("shared evidence "), (n % 7).cast("string"))).otherwise(F.col("html")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"), body.cast("binary").alias("content"), F.lit(NOW).cast("timestamp").alias("ts"))
    folder = streams.folder(spark, "attachments")
    for batch, part in (("even", 0), ("odd", 1), ("odd", 1)):
        attachments.store(pages.where(n % 2 == part), folder, batch, "page_id")
    entries = attachments.entries(pages.withColumn("name", n.cast("string")), n % 40, content_type=F.lit("text/html"))
    return attachments.checked(spark, entries, folder).select(F.col("name").cast("long").alias("page_id"), "case_id", "size", "sha256", "state")


# ---- dashboards in full, console filters, canonical sensor events


@query(
    f"""with {sql.INCIDENTS}, {_ORDERS} select a.*, i.*, c.*, 1 as sla_critical_hours, 4 as sla_high_hours, 24 as sla_medium_hours, 72 as sla_low_hours from
    (select count(*) as total_alerts, count(*) filter (event_id % 5 <> 0) as alerts_open, count(*) filter (severity = 'critical') as alerts_critical, count(*) filter (severity = 'high') as alerts_high,
      count(*) filter (severity = 'medium') as alerts_medium, count(*) filter (severity = 'low') as alerts_low, cast(coalesce(round_even(avg(risk), 0), 0) as integer) as avg_risk_score from dd) a,
    (select count(*) as total_incidents, count(*) filter (severity <> 'medium') as incidents_open, count(*) filter (severity = 'critical') as incidents_critical from inc) i,
    (select count(*) as total_cases, count(*) filter (o_orderstatus <> 'F') as cases_open, count(closed) as cases_closed from st) c"""
)
def kpi_components(spark, sf_dir):
    """Alerts of every fifth event are acknowledged, incidents of medium severity closed; orders are cases."""
    a = pipeline.deduplicated(spark, sf_dir).withColumn("status", F.when(F.pmod("event_id", F.lit(5)) == 0, "acknowledged").otherwise("open"))
    i = pipeline.incident_rows(spark, sf_dir).withColumn("status", F.when(F.col("severity") == "medium", "closed").otherwise("open"))
    c = _orders(spark, sf_dir).withColumn("status", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open"))
    return kpi.component_block(a, i, c)


@query(
    f"""with {sql.ALERTS}, p as (select 'top_rules' as section, rule_id as value from al union all select 'top_mitre', tag from al union all select 'top_iocs', ip_src from al where user_id % 10 = 0),
    n as (select section, value, count(*) as count from p group by all), m as (select unnest(generate_series(timestamp '{NOW}' - interval 59 minutes, timestamp '{NOW}', interval 1 minute)) as minute),
    c as (select date_trunc('minute', ts) as minute, count(*) as n from ev where ts between timestamp '{NOW}' - interval 59 minutes and timestamp '{NOW}' group by 1)
    select * from n qualify row_number() over (partition by section order by count desc, value) <= 10
    union all select 'alerts_by_rule', value, count from n where section = 'top_rules' union all values ('rules_total', null, 3), ('rules_enabled', null, 3)
    union all select 'critical_assets', s_name, 1 from supplier where s_acctbal > 5000 union all select 'trend', strftime(minute, '%H:%M'), coalesce(n, 0) from m left join c using (minute)"""
)
def detection_stats(spark, sf_dir):
    """Suppliers with much on their account are critical assets; every tenth user is a known indicator."""
    a = pipeline.alert_rows(spark, sf_dir).select("rule_id", F.col("tags").alias("mitre"), F.when(F.pmod("user_id", F.lit(10)) == 0, F.array("ip_src")).alias("ioc_ids"))
    held = spark.createDataFrame([(r.rule_id, r.enabled) for r in pipeline.registry().rules.values()], "rule_id string, enabled boolean")
    assets = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("hostname"), F.when(F.col("s_acctbal") > 5000, "critical").otherwise("low").alias("criticality"))
    return kpi.detection_stats(a, held, assets, pipeline.events(spark, sf_dir), NOW)


@query(
    f"""with {sql.EV}, {_ORDERS}, m as (select coalesce(floor(avg((epoch_us(closed) - epoch_us(created)) / 1e6)), 0) as mttr from st)
    select cast(floor(mttr / 60.0 + 0.5) as bigint) as mttr_minutes, (select count(*) from ev where ts between date_trunc('minute', timestamp '{NOW}') and timestamp '{NOW}') as events_last_hour from m"""
)
def console_metrics(spark, sf_dir):
    block = kpi.case_block(_orders(spark, sf_dir).withColumn("status", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")))
    return kpi.console_metrics(block, kpi.minute_series(pipeline.events(spark, sf_dir), NOW))


@query(
    f"""with {sql.DEDUP}, a as (select fingerprint, rule_id, severity, source_host, usr, first_seen from dd)
    select 'week' as list, fingerprint from a where first_seen >= timestamp '{NOW}' - interval 7 days and severity = 'high' and (lower(rule_id) like '%login%' or lower(source_host) like '%login%')
    union all select 'day', fingerprint from a where first_seen >= timestamp '{NOW}' - interval 1 day union all select 'host', fingerprint from a where source_host = 'host-7'"""
)
def triage_list(spark, sf_dir):
    a = pipeline.deduplicated(spark, sf_dir)
    now, columns = F.lit(NOW).cast("timestamp"), ["rule_id", "source_host"]
    lists = {
        "week": search.triage(a, now, "LOGIN", "7d", columns, severity="high", rule_id="all"),
        "day": search.triage(a, now, None, "24h", columns),
        "host": search.triage(a, now, "", "all", columns, source_host="host-7"),
    }
    return reduce(lambda x, y: x.unionByName(y), [found.select(F.lit(name).alias("list"), "fingerprint") for name, found in lists.items()])


@query(
    f"""with {_ORDERS}, q as (select id, severity, o_orderstatus as status, case when id % 4 <> 0 then state end as state, case when o_custkey % 3 = 0 then null when o_custkey % 3 = 1 then '' else 'o' end as owner from st)
    select 'late and nobody''s' as list, id from q where state in ('overdue', 'missed') and coalesce(owner, '') = '' union all select 'owned and critical', id from q where owner = 'o' and severity = 'critical'
    union all select 'no level', id from q where state is null and status = 'O' union all select 'fine', id from q where state in ('ok', 'met')"""
)
def queue_lists(spark, sf_dir):
    """The decision queue by service level, ownership and status."""
    customer = F.pmod("o_custkey", F.lit(3))
    q = _orders(spark, sf_dir).select(
        "id", "severity", F.col("o_orderstatus").alias("status"), F.when(F.pmod("id", F.lit(4)) != 0, F.col("sla_state")).alias("sla_state"), F.when(customer == 1, "").when(customer == 2, "o").alias("owner")
    )
    lists = {
        "late and nobody's": search.queue_filter(q, sla="overdue", ownership="unassigned"), "owned and critical": search.queue_filter(q, sla="all", ownership="assigned", severity="critical"),
        "no level": search.queue_filter(q, sla="none", status="O"), "fine": search.queue_filter(q, sla="ok", severity="all"),
    }
    return reduce(lambda x, y: x.unionByName(y), [found.select(F.lit(name).alias("list"), "id") for name, found in lists.items()])


_SENSOR_META = (
    """'{"asset":{"asset_id":"a-1","hostname":"host-' || user_id || '","ip":"10.0.0.1"},"contract_schema_version":"1.0","evidence":{"file_path":"etc/passwd"},"origin_event_id":"e' || event_id || '","source_component":"fim","source_instance_id":"i","source_metadata":{' """
    """|| case when event_id % 3 = 0 then '"correlation_id":"c' || user_id || '",' else '' end || '"tags":["t","b","t"]},"source_product_version":"1.2.3","source_sequence":' || event_id || ',"source_severity":"high"}'"""
)


@query(
    f"""with e as (select *, list_extract(['fim.file.added', 'hash.mismatch', 'alert.created'], event_id % 3 + 1) as kind from events)
    select 'e' || event_id as event_id, case when event_id % 3 = 0 then 'c' || user_id else 'e' || event_id end as trace_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as timestamp, 'sensor' as source_type,
    'host-' || user_id as hostname, case kind when 'alert.created' then 'alert' else 'file' end as event_category, case kind when 'hash.mismatch' then 'hash_changed' else 'created' end as event_action, 'high' as severity, 'v' as vendor,
    'b,t' as tags, 'asset,event_type,evidence,metadata,severity,source,timestamp' as normalized_fields, 1.0::double as confidence, {_SENSOR_META} as metadata, case when user_id % 10 = 0 then 'source_host' else '' end as errors from e"""
)
def canonical_sensor_events(spark, sf_dir):
    """The sensor's events as canonical ones, with their checks: of every tenth user the source host is lost on the way."""
    n, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    kind = F.element_at(F.array(F.lit("fim.file.added"), F.lit("hash.mismatch"), F.lit("alert.created")), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    text = F.concat(
        F.lit('{"event_id":"e'), n, F.lit('","schema_version":"1.0","sequence":'), n, F.lit(',"event_type":"'), kind, F.lit('","severity":"high","timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","source":{"product_version":"1.2.3","instance_id":"i","component":"fim"},"asset":{"asset_id":"a-1","ip":"10.0.0.1","hostname":"host-'), user, F.lit('"},"evidence":{"file_path":"etc/passwd"},"metadata":{'),
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit('"correlation_id":"c'), user, F.lit('",'))).otherwise(""), F.lit('"tags":["t","b","t"]}}'),
    )
    sent = table(spark, sf_dir, "events").select(text.alias("payload"), "ts")
    held = normalize.sensor_canonical(sent, "payload", F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp"), vendor="v", product="p")
    ok, refused = normalize.accepted(held.withColumn("source_host", F.when(~F.col("hostname").rlike("0$"), F.col("source_host"))))
    both = ok.withColumn("errors", F.array().cast("array<string>")).unionByName(refused)
    return both.select(
        "event_id", "trace_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "source_type", "hostname", "event_category", "event_action", "severity", "vendor",
        F.array_join("tags", ",").alias("tags"), F.array_join("normalized_fields", ",").alias("normalized_fields"), "confidence", "metadata", F.array_join("errors", ",").alias("errors"),
    )
