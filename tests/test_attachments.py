"""Attachments: files by their hash, retries, damage, contents that are read only where they are opened."""

import hashlib

from pyspark.sql import functions as F

from loomwatch.sources import attachments


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_files_are_stored_once_and_opened(spark, tmp_path):
    data = {"a.txt": b"one", "b.txt": b"one", "c.bin": bytes(range(256)) * 5000}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i, (name, content) in enumerate(data.items()):
        (tmp_path / "in" / ("deep" if i % 2 else "") / name).write_bytes(content)
    files, folder = attachments.files(spark, str(tmp_path / "in")), str(tmp_path / "store")
    attachments.store(files, folder, "1")
    attachments.store(files, folder, "1")
    attachments.store(files, folder, "2")
    held = attachments.contents(spark, folder).collect()
    assert sorted(r["sha256"] for r in held) == sorted({sha(x) for x in data.values()})
    entries = attachments.entries(files, F.lit("case-1"), added_by=F.lit("ann"))
    got = {r["name"]: bytes(r["content"]) for r in attachments.opened(spark, entries, folder).collect()}
    assert got == data
    assert {r["state"] for r in attachments.checked(spark, entries, folder).collect()} == {"stored"}
    one = attachments.summary(entries).collect()[0]
    assert (one["attachments"], one["bytes"], one["contents"]) == (3, sum(map(len, data.values())), 2)
    assert sorted(r["text"] for r in attachments.timeline(entries).collect())[0] == "Attachment 'a.txt' added"


def test_states(spark, tmp_path):
    rows = [(1, "x", b"kept"), (2, "y", b"lost"), (3, "z", None), (3, "z", None), (4, "w", b"kept"), (5, "e", b"")]
    files = spark.createDataFrame(rows, "id long, name string, content binary").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    folder = str(tmp_path)
    attachments.store(files.where("name <> 'y'"), folder, "1")
    entries = attachments.entries(files, F.col("id") % 2, url=F.lit("https://example.com"))
    state = lambda: sorted((r["name"], r["state"]) for r in attachments.checked(spark, entries, folder).collect())
    assert state() == [("e", "stored"), ("w", "stored"), ("x", "stored"), ("y", "missing"), ("z", "link"), ("z", "link")]
    wrong = spark.createDataFrame([(sha(b"lost"), 4, b"LOST")], "sha256 string, size long, content binary")
    wrong.write.parquet(f"{folder}/contents/batch=2")
    assert ("y", "damaged") in state()
    assert attachments.entries(files.limit(0), F.lit(1)).count() == 0
    attachments.store(files.limit(0), folder, "3")
    assert len(state()) == 6


def test_lists_read_no_contents(spark, tmp_path):
    files = spark.createDataFrame([(1, "x", b"kept")], "id long, name string, content binary").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    attachments.store(files, str(tmp_path), "1")
    stored = attachments.contents(spark, str(tmp_path)).where("batch <> '2'").select("sha256")
    assert "content:binary" not in stored._jdf.queryExecution().executedPlan().toString()
