"""The same plans in SQL that another engine runs, as common table expressions."""

EV = """ev as (
  select event_id, ts, user_id, event_type, value, 'host-' || user_id as source_host, '10.0.' || (user_id // 256) || '.' || (user_id % 256) as ip_src,
    'user-' || user_id as usr,
    case when event_type in ('error', 'signup') then 'auth' when event_type = 'purchase' then 'network' when event_type = 'click' then 'system' else 'process' end as category,
    case when event_type in ('error', 'purchase') then 'reject' when event_type = 'signup' then 'accept' when event_type = 'click' then 'info' else 'start' end as action,
    cast(case when value < 5 then 0.4 else 1.0 end as double) as confidence
  from events)"""

LOGIN = """login_f as (
  select *, count(*) over (partition by source_host order by ts range between interval 72 hours preceding and current row) as n
  from ev where category = 'auth' and action in ('reject', 'failed'))"""

BUSY = """busy_f as (
  select *, count(*) over (partition by ip_src order by ts range between interval 24 hours preceding and current row) as n from ev)"""

FOUND = f"""{EV}, {LOGIN}, {BUSY}, found as (
  select event_id, ts, ip_src, usr, source_host, value, user_id, confidence, 'login-failures' as rule_id, 'high' as severity, 3 as srank, 'T1110' as tag from login_f where n > 3
  union all
  select event_id, ts, ip_src, usr, source_host, value, user_id, confidence, 'large-reject', 'critical', 4, 'T1499' from ev where category = 'network' and action = 'reject' and value > 200
  union all
  select event_id, ts, ip_src, usr, source_host, value, user_id, confidence, 'busy-source', 'medium', 2, 'T1046' from busy_f where n >= 8)"""

PRIORITY = "case when {0} >= 80 then 'p1' when {0} >= 60 then 'p2' when {0} >= 40 then 'p3' when {0} >= 20 then 'p4' else 'p5' end"

ALERTS = f"""{FOUND}, al as (
  select *, {PRIORITY.format('risk')} as priority,
    substr(sha256('{{"ip_src":"' || ip_src || '","rule_id":"' || rule_id || '","source_host":"' || source_host || '","user":"' || usr || '"}}'), 1, 16) as fingerprint
  from (select *, cast(round_even((3.0::double * srank / 4.0::double + confidence) / 4.0::double * 100.0::double, 0) as integer) as risk from found))"""

DEDUP = f"""{ALERTS}, dd as (
  select * from (
    select *, row_number() over (partition by fingerprint order by ts, event_id) as k, count(*) over (partition by fingerprint) as occurrences,
      min(ts) over (partition by fingerprint) as first_seen, max(ts) over (partition by fingerprint) as last_seen
    from al) where k = 1)"""

INCIDENTS = f"""{DEDUP}, grouped as (
  select source_host as asset_id, count(*) as alerts, max(srank) as srank, avg(risk) as mean_risk, avg(confidence) as mean_confidence, min(first_seen) as first_seen, max(last_seen) as last_seen,
    20 + 20 + case when max(user_id % 10) = 0 and min(user_id % 10) = 0 then 25 else 0 end + case when count(distinct rule_id) = 1 then 20 else 0 end
      + case when count(distinct fingerprint) = 1 then 30 else 0 end + case when max(last_seen) - min(first_seen) <= interval 1 hour then 10 else 0 end + 20 as weight,
    string_agg(distinct rule_id, ',' order by rule_id) as rules, string_agg(distinct tag, ',' order by tag) as mitre, count(distinct rule_id) as n_rules
  from dd group by source_host
), inc as (
  select asset_id, alerts, cast(round_even(weight * 100.0::double / 145.0::double, 0) as integer) as score,
    case srank when 4 then 'critical' when 3 then 'high' when 2 then 'medium' when 1 then 'low' else 'info' end as severity, srank,
    cast(round_even(mean_risk, 0) as integer) as risk, mean_confidence, first_seen, last_seen, rules, mitre, n_rules
  from grouped where alerts >= 2 and round_even(weight * 100.0::double / 145.0::double, 0) >= 40)"""


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
