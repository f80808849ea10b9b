from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwatch.functions import checks, keys, severity, sla
from loomwatch.operators import alerts, contract, dsl, incidents, rules, search, syslog, windows

LINES = [
    ('<165>1 2026-08-03T12:00:00.000Z wks-01 sshd - - [meta sequenceId="1" q="a\\"b"] User admin logged in', ("rfc5424", "local4", "notice", "sshd", "User admin logged in", "auth", "info")),
    ("<11>1 2026-08-03T12:00:00.000Z wks-01 kernel - - - Kernel panic", ("rfc5424", "user", "error", "kernel", "- Kernel panic", "system", "info")),
    ("<13>Aug  3 12:00:00 wks-01 sshd[1234]: Accepted password for admin", ("rfc3164", "user", "notice", "sshd", "Accepted password for admin", "auth", "accept")),
    ("<10>Aug  3 12:00:01 fw-01 iptables: refused 10.0.0.1", ("rfc3164", "user", "critical", "iptables", "refused 10.0.0.1", "network", "reject")),
    ("<999>Aug  3 12:00:01 fw-01 x: y", ("rfc3164", "facility-124", "debug", "x", "y", "system", "info")),
    ("not a syslog message", None),
    ("", None),
    (None, None),
]


def test_syslog(spark):
    df = spark.createDataFrame([(i, t, datetime(2026, 1, 1)) for i, (t, _) in enumerate(LINES)], "event_id int, raw_payload string, received_at timestamp")
    for r in syslog.parse(df).collect():
        want, p = LINES[r["event_id"]][1], r["parsed"]
        assert (p and tuple(p[c] for c in ("format", "facility", "severity", "process", "message", "category", "action"))) == want
        assert r["parse_ok"] == (want is not None) and (r["category"], r["action"]) == (want[-2:] if want else ("system", "info"))
    first = syslog.parse(df).where("event_id = 0").first()["parsed"]
    assert first["structured_data"] == {"meta": {"sequenceId": "1", "q": 'a"b'}} and first["ts"] == datetime(2026, 8, 3, 12)
    assert syslog.parse(df).where("event_id = 2").first()["parsed"]["pid"] == "1234"
    assert syslog.unparsed(syslog.parse(df)).count() == 3


@pytest.mark.parametrize(("level", "confidence", "want"), [("critical", 1.0, 100), ("high", 1.0, 81), ("high", 0.9, 79), ("medium", 1.0, 62), ("low", 1.0, 44), ("info", 1.0, 25), ("info", 0.2, 5)])
def test_risk(spark, level, confidence, want):
    assert spark.range(1).select(severity.risk(F.lit(level), F.lit(confidence))).first()[0] == want


def test_risk_factors_and_priorities(spark):
    row = spark.range(1).select(
        severity.risk(F.lit("high"), F.lit(0.9), [severity.asset_factor(F.lit(100))]), *[severity.priority(F.lit(x)) for x in (80, 79, 60, 40, 20, 19)], severity.known(F.lit("HIGH")), severity.known(F.lit(None)), severity.known(F.lit("odd"))
    )
    assert list(row.first()) == [86, "p1", "p2", "p2", "p3", "p4", "p5", "high", "medium", "medium"]


def test_sla(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    at = lambda h: now - F.make_interval(hours=F.lit(h))
    none = F.lit(None).cast("timestamp")
    row = spark.range(1).select(
        sla.state(F.lit("critical"), at(2), none, now), sla.state(F.lit("low"), at(60), none, now), sla.state(F.lit("low"), at(1), none, now),
        sla.state(F.lit("low"), at(60), at(59), now), sla.state(F.lit("high"), at(60), at(2), now), sla.state(F.lit("odd"), at(25), none, now), sla.remaining(F.lit("high"), at(3), now), sla.remaining(F.lit("high"), at(5), now),
    )
    assert list(row.first()) == ["overdue", "warning", "ok", "met", "missed", "overdue", 3600.0, 0.0]


def test_fingerprint_is_of_sorted_json_without_nulls(spark):
    import hashlib

    df = spark.createDataFrame([("1.1.1.1", None, "h", "u")], "ip_src string, ip_dst string, source_host string, user string")
    want = hashlib.sha256(b'{"ip_src":"1.1.1.1","rule_id":"r","source_host":"h","user":"u"}').hexdigest()[:16]
    assert df.select(keys.alert_fingerprint(F.lit("r"))).first()[0] == want
    row = spark.range(1).select(keys.canonical_json(F.lit('{"b":1, "a":[1,null]}')), keys.canonical_json(F.lit('{"a":1,"a":2}')), keys.canonical_json(F.lit('{"a":NaN}')), keys.bounded(F.lit("  ab "), 1), keys.bounded(F.lit("  "), 3))
    assert list(row.first()) == ['{"a":[1,null],"b":1}', None, None, "a", None]


def test_checks(spark):
    good = {"is_ipv4": ["0.0.0.0", "255.1.2.3"], "is_ipv6": ["::", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "fe80::"], "is_hash": ["a" * 32, "a" * 33, "F" * 64, " " + "b" * 128], "is_email": ["a@b.c"], "is_url": ["https://a/b?c#d", "http://x", "ftp://a"], "is_hostname": ["a", "a-b.c9", "a..b", "a" * 64], "is_uuid4": ["12345678-1234-4123-8123-123456789abc"]}
    bad = {"is_ipv4": ["256.1.1.1", "1.2.3", "01.2.3.4", None], "is_ipv6": [":::", "1::2::3", "g::", "1:2:3:4:5:6:7", None], "is_hash": ["a" * 31, "a" * 129, "g" * 32, None], "is_email": ["a@b", "@b.c", None], "is_url": ["://a", "http://", None], "is_hostname": ["-a", "a.", "a" * 254, None], "is_uuid4": ["12345678-1234-1123-8123-123456789abc", "", None]}
    for want, cases in ((True, good), (False, bad)):
        for name, texts in cases.items():
            for t in texts:
                assert spark.range(1).select(getattr(checks, name)(F.lit(t).cast("string"))).first()[0] is want, (name, t)


def test_dsl(spark):
    df = spark.createDataFrame([("high", 5.0, ["x"], True, None), (None, None, None, None, "n")], "severity string, value double, tags array<string>, on boolean, other string")
    table = [
        ("severity", "==", "high", [True, False]), ("severity", "!=", "high", [False, True]), ("severity", ">", "medium", [True, False]), ("severity", "<=", "HIGH", [True, False]), ("value", ">=", 5, [True, False]), ("value", ">", "4", [False, False]),
        ("tags", "contains", "x", [True, False]), ("severity", "contains", "ig", [True, False]), ("severity", "in", ["high"], [True, False]), ("severity", "in", "high", [False, False]), ("value", "matches", "^5", [True, False]), ("severity", "matches", "(", [False, False]),
        ("on", "==", True, [True, False]), ("missing", "==", "x", [False, False]), ("missing", "!=", "x", [True, True]), ("other", "==", "n", [False, True]),
    ]
    for field, op, value, want in table:
        assert [r[0] for r in df.select(dsl.leaf(df, field, op, value)).collect()] == want, (field, op, value)
    for text in ("WHEN whatever", "WHEN THEN x", ""):
        with pytest.raises(ValueError):
            dsl.condition(df, text)


def test_registry():
    r = rules.Registry()
    for name, priority, needs in (("c", 50, ("a",)), ("b", 10, ()), ("a", 100, ()), ("d", 10, ())):
        r.register(rules.Rule(name, lambda e: e, priority=priority, depends_on=needs))
    assert [x.rule_id for x in r.ordered()] == ["b", "d", "a", "c"]
    r.enable("a", False)
    with pytest.raises(ValueError):
        r.ordered()
    r.enable("a")
    r.register(rules.Rule("x", lambda e: e, depends_on=("y",)))
    r.register(rules.Rule("y", lambda e: e, depends_on=("x",)))
    with pytest.raises(ValueError):
        r.ordered()
    assert r.stats() == {"total": 6, "enabled": 6, "by_priority": {10: 2, 50: 1, 100: 3}}
    assert r.get("d").priority == 10 and r.unregister("d").rule_id == "d" and r.get("d") is None


def alert(i, asset, minute, rule="brute", user="admin", iocs=()):
    return (f"a{i}", "t", rule, asset, user, "high" if i else "critical", 100 if not i else 81, 1.0, list(iocs), ["T1110"], f"fp{i}", datetime(2026, 8, 3, 12, minute), datetime(2026, 8, 3, 12, minute), "g")


ALERT = "alert_id string, title string, rule_id string, asset_id string, user string, severity string, risk int, confidence double, ioc_ids array<string>, mitre array<string>, fingerprint string, first_seen timestamp, last_seen timestamp, g string"


def test_grouping(spark):
    rows = [alert(0, "web-01", 0, iocs=["10.0.0.14"]), alert(1, "db-01", 1, user="svc"), alert(2, "web-02", 2), alert(3, "vpn", 3, user="alex")]
    got = incidents.group(spark.createDataFrame(rows, ALERT), ["g"]).first()
    assert (got["score"], got["severity"], got["risk"], got["priority"]) == (52, "critical", 86, "p1")
    assert got["criteria"] == ["ioc", "rule", "time_window", "mitre"] and len(got["assets"]) == 4 and len(got["users"]) == 3
    assert incidents.group(spark.createDataFrame(rows[:1], ALERT), ["g"]).count() == 0
    late = incidents.group(spark.createDataFrame(rows, ALERT), ["g"], seconds=60).first()
    assert "time_window" not in late["criteria"]
    cases = incidents.to_cases(incidents.group(spark.createDataFrame(rows, ALERT), ["g"]))
    assert cases.count() == 1 and incidents.to_cases(incidents.group(spark.createDataFrame(rows, ALERT), ["g"]), cases).count() == 0


def test_window_ties_count_in_order_of_arrival(spark):
    df = spark.createDataFrame([(1, "k", datetime(2026, 1, 1, 0, 0)), (2, "k", datetime(2026, 1, 1, 0, 0)), (3, "k", datetime(2026, 1, 1, 0, 5)), (4, None, datetime(2026, 1, 1))], "event_id long, k string, ts timestamp")
    got = df.withColumn("n", windows.window_count(["k"], "ts", "event_id", 300)).withColumn("ids", windows.window_ids(["k"], "ts", "event_id", 300)).where("k is not null").orderBy("event_id").collect()
    assert [(r["n"], r["ids"]) for r in got] == [(1, [1]), (2, [1, 2]), (3, [1, 2, 3])]
    assert [r["event_id"] for r in windows.over_threshold(df, ["k"], 2, 300, strict=True).collect()] == [3]


EVENT = '{"event_id":"12345678-1234-4123-8123-123456789abc","schema_version":"1.0","timestamp":"2026-01-01T00:00:00Z","sequence":1,"source":{"product":"p","product_version":"1.0.0","instance_id":"12345678-1234-4123-8123-123456789abc","component":"fim"},"event_type":"fim.baseline.created","severity":"info","asset":{"asset_id":"a","hostname":"h"},"evidence":{"baseline_id":"b","hash_algorithm":"md5","baseline_status":"created","details":{"file_count":1%s}}%s}'
META = ',"metadata":{}'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (EVENT % ("", META), []),
        (EVENT % (',"a":{"b":{"c":[1]}}', META), []),
        (EVENT % (',"a":{"b":{"c":[[1]]}}', META), ["invalid_details"]),
        (EVENT % (',"a":"[[[[[[[\\" null"', META), []),
        (EVENT % ("", ""), ["invalid_metadata"]),
        (EVENT % ("", META + ',"sequence":2'), ["invalid_json"]),
        ("{", ["invalid_json"]),
        (None, ["invalid_json"]),
    ],
)
def test_contract(spark, text, want):
    got = spark.range(1).select(contract.errors(F.lit(text).cast("string"), F.lit("2026-06-01").cast("timestamp"))).first()[0]
    assert got == want


def test_paging_and_search(spark):
    df = spark.createDataFrame([(i, i % 3, "Title %d" % i) for i in range(10)], "id int, s int, title string")
    assert [r["id"] for r in search.page(df, "s", 4, 0).collect()] == [2, 5, 8, 1] and search.page(df, "s", 4, 8).count() == 2 and search.page(df, "s", 0).count() == 1
    assert search.page_info(df, 4, 4).first()["has_more"] and not search.page_info(df, 4, 8).first()["has_more"]
    with pytest.raises(ValueError):
        search.where_all(df, [search.Filter("nope", "eq", 1)])
    assert search.search_alerts(df, "title 1").count() == 1


def test_lifecycle(spark):
    log = [("a", 1, "triage"), ("a", 2, "open"), ("a", 3, "resolved"), ("b", 1, "resolved"), ("b", 2, "open")]
    df = spark.createDataFrame(log, "id string, ts int, status string")
    assert {tuple(r) for r in alerts.replayed(df, alerts.ALERT_STATES).collect()} == {("a", "resolved", 2, 1), ("b", "open", 0, 1)}


def test_ingest_stream_is_idempotent(spark, tmp_path):
    from loomwatch.sources import readers
    from loomwatch.streaming import ingest

    event = (EVENT % ("", META)).replace("\n", "")
    other = event.replace("123456789abc\",\"schema", "123456789abd\",\"schema")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"batch_id":"b1","sent_at":"x","events":[%s,%s,{"event_id":1}]}\n' % (event, event))
    empty = spark.createDataFrame([], "source_instance_id string, event_id string, content_hash string")

    def go():
        stream = readers.sensor_batches(spark, str(tmp_path / "in"), stream=True)
        ingest.ingest(stream, str(tmp_path / "inbox"), str(tmp_path / "receipts"), str(tmp_path / "ck"), empty, "2026-06-01").start().awaitTermination()

    go()
    (tmp_path / "in/b.json").write_text('{"batch_id":"b2","sent_at":"x","events":[%s,%s]}\n' % (event, other))
    go()
    got = {r["batch_id"]: (r["accepted"], r["duplicate"], r["rejected"], r["status"]) for r in spark.read.parquet(str(tmp_path / "receipts")).collect()}
    assert got == {"b1": (1, 1, 1, "stored"), "b2": (1, 1, 0, "stored")}
    assert spark.read.parquet(str(tmp_path / "inbox")).count() == 2


def test_readers_and_stores(spark, tmp_path):
    from loomwatch.sources import readers, stores

    (tmp_path / "log.txt").write_text("<13>Aug  3 12:00:00 h p: m\nplain\n")
    raw = readers.raw_lines(spark, str(tmp_path / "log.txt"))
    assert sorted(r["parse_ok"] for r in syslog.parse(raw).collect()) == [False, True]
    good, bad = readers.usable_raw(raw.withColumn("source_host", F.when(F.col("raw_payload") == "plain", "").otherwise("h")))
    assert (good.count(), bad.count()) == (1, 1)
    trail = spark.createDataFrame([("parse", "c1", datetime(2026, 1, 1)), ("detect", "c1", datetime(2026, 1, 2)), ("parse", "c2", datetime(2026, 1, 3))], "stage string, correlation_id string, ts timestamp")
    stores.append_trail(trail, str(tmp_path / "trail"))
    stores.append_trail(trail.limit(1), str(tmp_path / "trail"))
    assert [r["correlation_id"] for r in stores.trail(spark, str(tmp_path / "trail"), stage="parse").collect()] == ["c2", "c1", "c1"]
    assert stores.trail(spark, str(tmp_path / "trail"), correlation_id="c1").count() == 3
    inbox = spark.createDataFrame([("i1", "e"), ("i2", "e"), ("i1", "f")], "source_instance_id string, event_id string")
    assert stores.one_by_event(inbox, "f").count() == 1
    with pytest.raises(Exception, match="ambiguous"):
        stores.one_by_event(inbox, "e").collect()
    assert stores.without(inbox.withColumnRenamed("event_id", "id"), spark.createDataFrame([("e",)], "id string")).count() == 1


def test_case_log(spark):
    from loomwatch.operators import cases

    at = lambda i: datetime(2026, 1, 1, 0, i)
    log = [("c", at(1), "claim", "ann"), ("c", at(2), "claim", "bob"), ("c", at(3), "transition", "in_progress"), ("c", at(4), "transition", "in_progress"), ("c", at(5), "resolve", "done"), ("c", at(6), "close", None), ("c", at(7), "transition", "reopened"), ("c", at(8), "assign", "eve"), ("d", at(1), "transition", "reopened")]
    got = {r["case_id"]: tuple(r)[1:] for r in cases.state(spark.createDataFrame(log, "case_id string, ts timestamp, kind string, value string")).collect()}
    assert got == {"c": ("reopened", "eve", "done", at(6), 1), "d": ("open", None, None, None, 1)}
    rows = spark.createDataFrame([("c", at(1), "file", "x"), ("c", at(2), "log", "x"), ("c", at(3), "odd", "y")], "case_id string, ts timestamp, kind string, label string")
    good, bad = cases.evidence(rows)
    assert good.first()["kind"] == "file" and bad.count() == 1
    t = spark.createDataFrame([("c", 1, at(1), "created", "A"), ("c", 1, at(2), "completed", None), ("c", 2, at(1), "created", "B")], "case_id string, task_id int, ts timestamp, action string, title string")
    assert {(r["task_id"], r["title"], r["done"]) for r in cases.tasks(t).collect()} == {(1, "A", True), (2, "B", False)}
    o = spark.createDataFrame([("c", at(1), "ann"), ("c", at(2), "ann"), ("c", at(3), "bob")], "case_id string, ts timestamp, owner string")
    assert [(r["before"], r["after"]) for r in cases.owners(o).orderBy("ts").collect()] == [(None, "ann"), ("ann", "bob")]
    n = spark.createDataFrame([("i", "x", at(2)), ("i", "y", at(1)), ("j", "z", at(1))], "incident_id string, case_id string, created_at timestamp")
    assert [r["case_id"] for r in cases.open_once(n, n.where("incident_id = 'j'")).collect()] == ["y"]
    assert list(spark.range(1).select(cases.duration(F.lit(90061)), cases.duration(F.lit(7260)), cases.duration(F.lit(59))).first()) == ["1d 1h", "2h 1m", "0m"]
    e = spark.createDataFrame([(7, "HIGH", at(1)), (8, None, at(1))], "event_id int, severity string, ts timestamp")
    assert [(r["incident_id"], r["risk"], r["priority"]) for r in cases.incident_of_event(e).orderBy("incident_id").collect()] == [("sensor-event:7", 80, "p1"), ("sensor-event:8", 60, "p2")]


def test_plugins_and_health(spark, tmp_path):
    import pandas as pd

    from loomwatch.operators.plugins import Plugins
    from loomwatch.streaming.health import Reports

    p = Plugins()
    p.parsers["words"] = (lambda b: pd.DataFrame({"w": [w for t in b["t"] for w in t.split()]}), "w string")
    df = spark.createDataFrame([("a b",), ("",), ("c",)], "t string")
    assert sorted(r["w"] for r in p.parse("words", df).collect()) == ["a", "b", "c"]
    p.exporters = {"bad": lambda d, i: 1 / 0, "good": lambda d, i: d.write.parquet(str(tmp_path / "out"))}
    outcome = p.export(df, 0)
    assert outcome["good"] == "exported" and outcome["bad"].startswith("failed")
    assert Reports().table(spark).count() == 0


def test_queue_falls_back_to_alerts(spark):
    from loomwatch.operators import kpi

    a, none = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "id string")
    assert kpi.queue_sources(none, none, a).count() == 1 and kpi.queue_sources(a.withColumn("id", F.lit("i")), none, a).first()["id"] == "i"
