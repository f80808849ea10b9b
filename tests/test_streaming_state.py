"""Ordered state, the bucketed store and ingestion over several micro-batches."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import alerts
from loomwatch.streaming import buckets, ingest, ordered

START = datetime(2024, 1, 1)
ALERT = "event_id long, ts timestamp, user string, asset_id string, rule_id string, fingerprint string, ioc_ids array<string>, mitre array<string>, severity string, risk int"


def at(minutes):
    return START + timedelta(minutes=minutes)


def alert(i, minutes, asset="a", rule="r", severity="high", risk=80):
    return (i, at(minutes), "u", asset, rule, f"{asset}{rule}", [], ["T1"], severity, risk)


def streamed(spark, tmp_path, parts, schema, make, columns):
    """Rows that come in one file a micro-batch, and what the stream tells of them."""
    own = ordered.session(spark)
    rows = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = own.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = make(source).writeStream.foreachBatch(ingest.write_once(str(tmp_path / f"out{k}"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        writer.start().awaitTermination()
        if (tmp_path / f"out{k}").exists():
            rows.append(sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / f"out{k}")).select(*columns).collect()), key=str))
    return rows


def test_incidents_over_micro_batches_in_any_order(spark, tmp_path):
    parts = [
        [alert(3, 50), alert(1, 10), alert(9, 5, asset=None)],
        [alert(2, 30), alert(4, 100, severity="critical"), alert(7, 300, asset="b")],  # late by less than an hour
        [alert(5, 1000), alert(6, 1010), alert(8, 2000, asset="z")],
    ]
    make = lambda s: ordered.incident_changes(s, "asset_id", 120 * 60)
    got = sum(streamed(spark, tmp_path, parts, ALERT, make, ["key", "event_id", "decision", "occurrences", "last_seen", "severity"]), [])
    of = lambda key: sorted((r[1:] for r in got if r[0] == key), key=lambda r: (r[3], r[0] is None))
    assert of("a") == [
        (1, "no_group", 0, at(10), "high"), (2, "new", 1, at(30), "high"), (3, "dedup", 2, at(50), "high"), (4, "dedup", 3, at(100), "high"), (None, "ended", 3, at(100), "high"),
        (5, "no_group", 0, at(1000), "high"), (6, "new", 1, at(1010), "high"), (None, "ended", 1, at(1010), "high"),
    ]
    assert of("b") == [(7, "no_group", 0, at(300), "high")] and not of("z")  # the watermark has not reached z


def test_decisions_are_deferred_until_the_window_closes(spark, tmp_path):
    e = lambda i, m, key="k": (i, at(m), key)
    parts = [[e(1, 0), e(2, 60), e(3, 61)], [e(4, 500), e(5, 560)], [e(6, 2000, "other")]]
    make = lambda s: ordered.threshold_decisions(s, "key", 3, 3600)
    got = sum(streamed(spark, tmp_path, parts, "event_id long, ts timestamp, key string", make, ["event_id", "decision", "told_at"]), [])
    told = sorted(got, key=lambda r: (r[2], r[0]))
    # The window includes its lower end: at 60 the first event counts, at 61 no more.
    assert told == [
        (1, "deferred", at(0)), (1, "no_match", at(60)), (2, "deferred", at(60)), (3, "deferred", at(61)), (2, "no_match", at(120)), (3, "no_match", at(121)),
        (4, "deferred", at(500)), (4, "no_match", at(560)), (5, "deferred", at(560)), (5, "no_match", at(620)),
    ]


def test_decisions_match_earlier_ones_of_the_window(spark, tmp_path):
    parts = [[(i, at(10 * i), "k") for i in (1, 2, 3)], [(9, at(5000), "x")]]
    got = sum(streamed(spark, tmp_path, parts, "event_id long, ts timestamp, key string", lambda s: ordered.threshold_decisions(s, "key", 3, 3600), ["event_id", "decision"]), [])
    assert sorted(got) == [(1, "deferred"), (1, "match"), (2, "deferred"), (2, "match"), (3, "match")]


def stored(spark, store, lots, n):
    for b in range(lots):
        store.append(spark.range(b * n, b * n + n).select(F.col("id").cast("string").alias("k"), F.lit(b).alias("v")), b)


def test_buckets_merge_and_find(spark, tmp_path):
    store = buckets.Buckets(str(tmp_path / "s"), ["k"], "k string, v int", each=50)
    stored(spark, store, 13, 100)
    assert store.all(spark).count() == 1300 and len(store.folders(spark)) <= 7
    wanted = spark.createDataFrame([("5",), ("1234",), ("none",)], "k string")
    found = {tuple(r) for r in store.lookup(wanted).collect()}
    assert {("5", 0), ("1234", 12)} <= found and len(found) < 600
    assert len(store.versions(spark)) <= buckets.KEEP
    before = {tuple(r) for r in store.lookup(wanted, 12).collect()}  # as it was before micro-batch 12
    assert ("5", 0) in before and ("1234", 12) not in before
    store.append(spark.createDataFrame([("x", 1)], "k string, v int"), 12)  # a retry replaces what the first try left
    assert store.all(spark).count() == 1201


def test_what_a_lookup_reads_does_not_grow_with_the_store(spark, tmp_path):
    sizes = {}
    wanted = spark.createDataFrame([("7",)], "k string")
    for lots in (4, 32):
        store = buckets.Buckets(str(tmp_path / f"s{lots}"), ["k"], "k string, v int", each=500)
        stored(spark, store, lots, 1000)
        found = store.lookup(wanted)
        sizes[lots] = sum(Path(f.removeprefix("file:")).stat().st_size for f in found.inputFiles())
        assert found.where("k = '7'").count() == 1 and found.count() < 5000
    assert sizes[32] < 3 * sizes[4]


def test_batches_in_turn_store_nothing_of_one_with_a_conflict(spark):
    inbox = spark.createDataFrame([("i", "old", "h")], "source_instance_id string, event_id string, content_hash string")
    e = lambda turn, position, of, h, errors=(): (turn, f"b{turn}", position, "i", of, h, list(errors))
    rows = [
        e(1, 0, "a", "1"), e(1, 1, "old", "other"),  # a conflict with the inbox: a is not stored
        e(2, 0, "a", "2"), e(2, 1, "c", "1"),  # so a is new here
        e(3, 0, "a", "1"),  # and this one a conflict
        e(4, 0, "c", "1"), e(4, 1, "c", "1"), e(4, 2, "d", "1", ["bad"]), e(4, 3, "old", "h"),
        e(5, 0, "a", "2"),
    ]
    df = spark.createDataFrame(rows, "turn long, batch_id string, position int, source_instance_id string, event_id string, content_hash string, errors array<string>")
    got = {(r["turn"], r["position"]): (r["ack"], r["batch_conflict"]) for r in ingest.in_turn(df, inbox).collect()}
    assert {k for k, v in got.items() if v[1]} == {(1, 0), (1, 1), (3, 0)}
    assert [got[k][0] for k in ((2, 0), (2, 1), (4, 0), (4, 1), (4, 2), (4, 3), (5, 0))] == ["accepted", "accepted", "duplicate", "duplicate", "rejected", "duplicate", "duplicate"]


def test_an_event_that_many_batches_send_is_judged_once(spark, tmp_path, monkeypatch):
    """What a batch is answered does not depend on it, and the inbox has the accepted event's text."""
    from loomwatch.plans import catalogue

    seen, judge = [], ingest.judged_events
    monkeypatch.setattr(ingest, "judged_events", lambda events, now: (seen.append(events.count()), judge(events, now))[1])
    uid = lambda n: f"{n:08x}-0000-4000-8000-{n:012x}"
    event = catalogue._event_json().replace("@ID", uid(1)).replace("@TS", "2024-01-01T00:00:00Z")
    batch = lambda n, *events: (n, f'{{"batch_id":"{uid(n)}","sent_at":"2024-01-01T00:00:00Z","events":[{",".join(events)}]}}')
    rows = [batch(n, event) for n in range(20)] + [batch(20, event, event), batch(21, event.replace('"sequence": 1', '"sequence": 2')), batch(22, '"text"'), (23, "{}")]
    spark.createDataFrame(rows, "turn long, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    sent = spark.readStream.schema("turn long, payload string").parquet(str(tmp_path / "in"))
    ingest.receive(sent, str(tmp_path / "out"), str(tmp_path / "ck"), "2024-06-01").start().awaitTermination()
    got = {r["turn"]: (r["state"], r["accepted"], r["duplicate"], r["rejected"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out/responses")).collect()}
    assert seen == [3]
    assert got[0] == ("new", 1, 0, 0, "stored") and all(got[n] == ("new", 0, 1, 0, "stored") for n in range(1, 20)) and got[20] == ("new", 0, 2, 0, "stored")
    assert got[21] == ("new", None, None, None, "conflict") and got[22] == ("new", 0, 0, 1, "rejected") and got[23][0] == "invalid"
    held = buckets.Buckets(str(tmp_path / "out/inbox"), ingest.EVENT_KEY, ingest.INBOX).all(spark).collect()
    assert len(held) == 1 and held[0]["event_id"] == uid(1) and '"sequence":1' in held[0]["payload"]


def brute(log, states, terminal="closed", keep=False):
    status, moves, refused, moved, closed = "open", 0, 0, None, None
    for ts, s in sorted(log):
        if s == status:
            continue
        if s not in states.get(status, ()):
            refused += 1
            continue
        status, moves, moved = s, moves + 1, ts
        closed = ts if s == terminal else closed if keep else None
    return status, moves, refused, moved, closed


@pytest.mark.parametrize("keep", [False, True])
def test_lifecycles_compose(spark, monkeypatch, keep):
    import random

    monkeypatch.setattr(alerts, "PIECE_BITS", 3)
    rng, names = random.Random(4), [*alerts.INCIDENT_STATES, "odd"]
    logs = {k: [(at(i), rng.choice(names)) for i in range(n)] for k, n in (("hot", 900), ("a", 1), ("b", 9), ("c", 40))}
    rows = [(k, ts, s) for k, log in logs.items() for ts, s in log] + [(None, at(0), "triage"), ("a", None, "triage")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, ts timestamp, status string").repartition(5)
    got = {r["id"]: tuple(r)[1:] for r in alerts.lifecycle(df, alerts.INCIDENT_STATES, keep_closed=keep).collect()}
    assert got == {k: brute(log, alerts.INCIDENT_STATES, keep=keep) for k, log in logs.items()}
