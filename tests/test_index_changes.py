"""Indexed search against the plain one, change feeds, rules measured apart, keys and formats of the contract."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomwatch.functions import checks, keys
from loomwatch.operators import changes, rules
from loomwatch.sources import textindex

TEXTS = ["Failed login of Ann", "failed LOGIN of bob", "x", "", None, "100% sure_thing", "été à Paris", "ab", "abcabc", "login failed " * 5000]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    held = textindex.TextIndex(str(tmp_path_factory.mktemp("index")))
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, "failed login", "k")] + [(100 + i, f"row {i % 7} of many", "k") for i in range(2000)]
    held.write(spark.createDataFrame(rows, "id long, text string, more string"))
    return held


@pytest.mark.parametrize("value", ["failed login", "LOGIN", "fail%ann", "sure_thing", "ÉTÉ", "bcab", "ab", "", "%", "nowhere to be found", "row 3 of", "of many", "_ow 3"])
def test_search_finds_what_a_scan_finds(spark, index, value):
    plain = spark.read.parquet(f"{index.path}/texts").where(F.col("text").ilike(f"%{value}%"))
    assert sorted(r["id"] for r in index.search(spark, value).collect()) == sorted(r["id"] for r in plain.collect())


def test_search_reads_candidates_only(spark, index):
    plan = index.search(spark, "failed login of")._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [0,1])]" in plan
    assert index.search(spark, "zzz never").count() == 0


def test_grams_are_computed_once_a_row(spark, tmp_path, monkeypatch):
    """Dealing rows by range looks at them twice; the grams are not worked out again."""
    seen = spark.sparkContext.accumulator(0)

    def listed(text):
        seen.add(1)
        return sorted({ord(c) for c in text})

    monkeypatch.setattr(textindex, "grams", F.udf(listed, "array<bigint>"))
    held = textindex.TextIndex(str(tmp_path))
    held.write(spark.createDataFrame([(i, f"row {i} of many") for i in range(500)], "id long, text string"))
    assert seen.value == 500
    want = sorted((ord(c), i) for i in range(500) for c in set(f"row {i} of many"))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{held.path}/postings").select("gram", "id").collect()) == want


def test_changes_and_hooks(spark):
    schema = "id long, status string, v double"
    before = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, None, None), (4, "x", 0.0)], schema)
    after = spark.createDataFrame([(1.0, 1, "a"), (3.0, 2, "a"), (None, 3, "b"), (9.0, 5, None)], "v double, id long, status string")
    found = changes.changes(before, after, "id")
    assert {tuple(r) for r in found.collect()} == {(2, "updated", "a", "a"), (3, "status_changed", None, "b"), (4, "deleted", "x", None), (5, "created", None, None)}
    assert changes.changes(before, before.withColumn("added", F.lit(None).cast("string")), "id").count() == 0
    seen = []
    hooks = changes.Hooks().on("created", "good", lambda df, b: seen.append((b, df.count()))).on("deleted", "bad", lambda df, b: 1 / 0).on("updated", "late", lambda df, b: seen.append(df.first()["id"]))
    assert hooks.run(found, 7) == {"good": "done", "bad": "failed: division by zero", "late": "done"} and seen == [(7, 1), 2]


def test_a_rule_that_does_not_fit_leaves_the_others(spark):
    events = spark.createDataFrame([(1, "auth", "u"), (2, "auth", ""), (3, "net", "v"), (4, None, "w")], "event_id long, category string, user string")
    held = [
        rules.Rule("column", F.col("event_id") > 0, "low", required=("user",), categories=("auth",)), rules.Rule("broken", F.col("nowhere") == 1, "low"),
        rules.Rule("window", lambda e: e.where("event_id % 2 = 1"), "high"),
    ]
    run = rules.measured(events, held, ["event_id"])
    assert sorted((r["rule_id"], r["event_id"]) for r in run.found.collect()) == [("column", 1), ("window", 1), ("window", 3)]
    got = {r["rule_id"]: (r["executions"], r["detections"], r["failure"]) for r in run.metrics(spark).collect()}
    assert got["column"] == (1, 1, None) and got["window"] == (4, 2, None) and got["broken"][2].startswith("UNRESOLVED_COLUMN")


def test_incident_fingerprints_are_of_ascii_json(spark):
    for value in ("host-1", "hôte \"1\"", "日本", "a😀b", None):
        df = spark.createDataFrame([(value,)], "asset_id string")
        want = hashlib.sha256(json.dumps({"asset": value}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
        assert df.select(keys.incident_fingerprint({"asset_id": F.col("asset_id")})).first()[0] == want


def test_formats_end_where_the_text_ends(spark):
    uid = "12345678-1234-4123-8123-123456789abc"
    df = spark.createDataFrame([(uid, "2024-01-01T00:00:00Z"), (uid + "\n", "2024-01-01T00:00:00Z\n"), (uid.upper(), "0000-01-01T00:00:00Z")], "u string, t string")
    assert [tuple(r) for r in df.select(checks.is_uuid4(F.col("u")), checks.utc_time(F.col("t")).isNotNull()).collect()] == [(True, True), (False, False), (False, False)]
