import io
import json
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from loomwatch.functions import checks
from loomwatch.operators import contract

def now():
    return F.lit("2025-01-01").cast("timestamp")


def explained(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_rules_are_compiled_and_an_event_is_written_as_json_for_its_trees_only(spark):
    """Rules within a lambda's argument are interpreted; JSON of every part was the larger half of the time."""
    plan = explained(contract.with_errors(spark.createDataFrame([("{}",)], "payload string"), "payload", now()))
    assert "filter(array(" not in plan
    assert plan.count("to_json(") <= 3


def test_failures_in_order(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (1, 2)], "a int, b int").select(checks.failures({"b": F.col("b") == 2, "a": F.col("a") == 1}).alias("f"))
    assert [r["f"] for r in df.collect()] == [["b"], ["a"], []]


def test_bytes_are_those_of_canonical_json(spark):
    """White space does not count, and what is longer when written out does."""
    of = lambda n: json.dumps({"evidence": {"details": {"k": "v" * n}}})
    texts = [of(60_000), " " * 70_000 + of(60_000), of(70_000), '{"n":[' + ",".join(["1e6"] * 7000) + "]}", '{"n":[' + ",".join(["1e6"] * 5000) + "]}"]
    got = contract.with_errors(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string"), "payload", now()).orderBy("i").collect()
    assert ["too_large" in r["errors"] for r in got] == [False, False, True, True, False]


def test_members_of_what_is_no_object(spark):
    """A part that is no object has no members, whatever the others are."""
    texts = ["[]", "5", '{"asset": [1], "source": 5, "evidence": "x", "metadata": null, "severity": "high"}']
    for r in contract.with_errors(spark.createDataFrame([(t,) for t in texts], "payload string"), "payload", now()).collect():
        assert {"invalid_asset", "invalid_source", "invalid_evidence", "invalid_details", "invalid_metadata"} <= set(r["errors"])
        assert ("invalid_severity" in r["errors"]) == (r["payload"] in ("[]", "5"))


def test_ingestion_parses_once(spark):
    """An event is parsed once for its hash, key and rules; a batch's canonical JSON is written once for its limits, keys and hash."""
    from loomwatch.functions import keys
    from loomwatch.streaming import ingest

    text = r'{"n": [1.50, 1e6, -0.0, 1E-7, 12345678901234567890123456789012345678901, "é\/\n"], "event_id": "x"}'
    rows = spark.createDataFrame([("b", 0, text)], "batch_id string, position int, payload string")
    judged = ingest.judged_events(rows, now())
    assert explained(judged).lower().count("parsejson(") == 1
    got, want = judged.first(), rows.select(keys.content_hash(F.col("payload")).alias("h"), keys.canonical_json(F.col("payload")).alias("c")).first()
    assert got["content_hash"] == want["h"] and got["event_id"] == "x"
    batches = contract.batch_errors(rows.select("payload"), canonical="c")
    assert "lambda" not in explained(batches) and batches.first()["c"] == want["c"]


def test_events_of_a_batch_are_its_members_however_they_look(spark):
    """Texts are cut out of the canonical JSON only where that is the same as writing each member."""
    head = '{"sent_at":"2024-01-01T00:00:00Z","batch_id":"12345678-0000-4000-8000-123456789012","events":'
    of = {
        '[{"b":"x\\"y\\u00e9","a":1e6},{"t":"},{"}]': ['{"a":1000000.0,"b":"x\\"yé"}', '{"t":"},{"}'], '["{}",{}]': ['"{}"', "{}"], '[1,null,[1],true]': ["1", "null", "[1]", "true"],
        '[{"a":{"events":[{}]}}]': ['{"a":{"events":[{}]}}'], "[]": [], "{}": None,
    }
    rows = spark.createDataFrame([(k, head + k + "}") for k in of] + [("more", head + '[{}],"x":1}')], "k string, payload string")
    got = {r["k"]: (r["e"], r["batch_errors"]) for r in contract.batch_errors(rows, events="e").collect()}
    assert {k: got[k][0] for k in of} == of
    assert got["more"] == (["{}"], ["unknown_field"]) and got["[]"][1] == got["{}"][1] == ["invalid_events"]
