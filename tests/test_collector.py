"""The log collector: offsets between lines, limits, restarts, splits within lines."""

import pytest

from loomwatch.sources import collector


def write(path, name, data, mode="wb"):
    with open(path / name, mode) as f:
        f.write(data)


@pytest.fixture
def stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    collector.register(spark)

    def run(**options):
        reader = spark.readStream.format("log_lines").options(path=str(logs), **options).load()
        out = reader.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        query = (out if "bytesPerTrigger" in options else out.trigger(availableNow=True)).start()
        query.processAllAvailable() if "bytesPerTrigger" in options else query.awaitTermination()
        took = [p["numInputRows"] for p in query.recentProgress]
        query.stop()
        return sorted(r["raw_payload"] for r in spark.read.parquet(str(tmp_path / "out")).collect()), took

    return logs, run


def test_restarts_neither_lose_nor_repeat(stream):
    logs, run = stream
    write(logs, "a.log", b"one\r\ntwo\nunend")
    assert run()[0] == ["one", "two"]
    write(logs, "a.log", b"ed\n\n\xff\n", "ab")
    assert run()[0] == sorted(["one", "two", "unended", "", "�"])
    assert run()[0] == sorted(["one", "two", "unended", "", "�"])
    write(logs, "a.log", b"tail", "ab")
    write(logs, "b.log", b"three\n")
    write(logs, ".hidden", b"no\n")
    assert run()[0] == sorted(["one", "two", "unended", "", "�", "tail", "three"])


def test_limited_batches_go_on_after_a_restart(stream, tmp_path):
    logs, run = stream
    limits = {"bytesPerTrigger": "100", "planned": str(tmp_path / "plan" / "offset")}
    lines = [f"line {i:04}" for i in range(60)]
    write(logs, "a.log", "".join(f"{x}\n" for x in lines[:30]).encode())
    got, took = run(**limits)
    assert got == lines[:30] and max(took) <= 11 and sum(took) == 30
    write(logs, "b.log", "".join(f"{x}\n" for x in lines[30:]).encode())
    got, took = run(**limits)
    assert got == lines and max(took) <= 22


def test_a_file_before_the_offset_is_an_error(stream):
    logs, run = stream
    write(logs, "b.log", b"x\n")
    run()
    write(logs, "a.log", b"late\n")
    write(logs, "c.log", b"y\n")
    with pytest.raises(Exception, match="appeared before"):
        run()


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 10_000])
def test_splits_keep_every_line_once(spark, tmp_path, split):
    data = b"\n".join(b"x" * (i % 9) for i in range(80)) + b"\nlast"
    write(tmp_path, "a", data)
    write(tmp_path, "b", b"")
    write(tmp_path, "c", b"\n" * 5)
    folder = collector.Folder({"path": str(tmp_path), "splitBytes": str(split)})
    files = folder.listed()
    parts = folder.splits(collector.START, {"file": "c", "at": files[-1].size})
    got = [(p.file, at, line) for p in parts for at, line in folder.lines(p)]
    assert len(set(got)) == len(got)
    assert b"".join(line for f, _, line in sorted(got) if f == "a") == data and sum(f == "c" for f, *_ in got) == 5


def test_batch_takes_unended_lines_and_empty_folders(spark, tmp_path):
    collector.register(spark)
    (tmp_path / "logs").mkdir()
    load = lambda: spark.read.format("log_lines").option("path", str(tmp_path / "logs")).option("sourceHost", "h").load()
    assert load().count() == 0
    write(tmp_path / "logs", "a", b"one\nend")
    rows = load().collect()
    assert sorted(r["raw_payload"] for r in rows) == ["end", "one"] and {r["source_host"] for r in rows} == {"h"} and len({r["event_id"] for r in rows}) == 2


def test_metadata():
    assert "streaming" in collector.LogLines.metadata.capabilities and "rate_limit" not in collector.LogLines.metadata.capabilities
    with pytest.raises(ValueError, match="blank"):
        collector.Metadata("a", " ", "file")
    with pytest.raises(ValueError, match="unknown"):
        collector.Metadata("a", "1", "file", capabilities=frozenset({"telepathy"}))
