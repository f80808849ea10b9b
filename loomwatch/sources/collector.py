"""A folder of growing log files as a Python data source, in batch and as a stream with offsets.

    collector.register(spark)
    spark.readStream.format("log_lines").option("path", folder).load()

Files are taken in the order of their names, as rotated logs are written: only the last one still grows. An offset is
a file, how many of its bytes are read, and how many files lie up to it. A line without its end in the last file
waits for the rest; in an earlier one it counts as whole. A file that appears before the offset would be lost, so it
is an error. Offsets always lie between lines.

Options: path; sourceType (file) and sourceHost (unknown); splitBytes, the size of a task (64 MB); bytesPerTrigger, the
most that a micro-batch takes, which needs planned, a file that holds the offset handed out last. Spark does not tell
a restarted reader where it stood; that file is written before the offset is handed out, so it is never behind the
checkpoint, and at worst one micro-batch after a restart is twice as large. Trigger.AvailableNow asks for one offset
only: use it without bytesPerTrigger.

Paths are those of pyarrow's file systems (local or shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomwatch.sources.readers import RAW
from loomwatch.streaming.health import CAPABILITIES

BATCH_BYTES, BLOCK = 4 << 20, 1 << 20
START = {"file": "", "at": 0, "files": 0}


@dataclass(frozen=True)
class Metadata:
    """What a collector says of itself; name, version and source type may not be blank."""

    name: str
    version: str
    source_type: str
    description: str = ""
    capabilities: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        for part in ("name", "version", "source_type"):
            if not getattr(self, part).strip():
                raise ValueError(f"{part} is blank")
        if unknown := self.capabilities - set(CAPABILITIES):
            raise ValueError(f"unknown capabilities: {sorted(unknown)}")


class Split(InputPartition):
    def __init__(self, file: str, start: int, end: int, aligned: bool) -> None:
        self.file, self.start, self.end, self.aligned = file, start, end, aligned


class Folder:
    """The files of the path and their lines."""

    def __init__(self, options: dict) -> None:
        self.files, self.path = fs.FileSystem.from_uri(options["path"])
        self.kind, self.host = options.get("sourceType", "file"), options.get("sourceHost", "unknown")
        self.split = int(options.get("splitBytes", 64 << 20))

    def listed(self) -> list[fs.FileInfo]:
        """By name, hidden files and those of Spark aside."""
        found = self.files.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)

    def opened(self, name: str) -> pa.NativeFile:
        return self.files.open_input_file(f"{self.path}/{name}")

    def last_line_end(self, name: str, start: int, size: int) -> int:
        """The end of the last whole line of [start, size); start if there is none."""
        with self.opened(name) as f:
            at = size
            while at > start:
                low = max(start, at - BLOCK)
                f.seek(low)
                if (place := f.read(at - low).rfind(b"\n")) >= 0:
                    return low + place + 1
                at = low
        return start

    def line_end_from(self, name: str, at: int, most: int) -> int:
        """The end of the line that holds the byte before at, at most most."""
        with self.opened(name) as f:
            at -= 1
            f.seek(at)
            while at < most:
                block = f.read(min(BLOCK, most - at))
                if (place := block.find(b"\n")) >= 0:
                    return at + place + 1
                at += len(block)
        return most

    def ends(self, files: list[fs.FileInfo], start: dict) -> Iterator[tuple[str, int, int]]:
        """(name, from, to) of what is to be read of each file from start on."""
        for i, f in enumerate(files):
            if f.base_name >= start["file"]:
                low = start["at"] if f.base_name == start["file"] else 0
                yield f.base_name, low, f.size if i + 1 < len(files) else self.last_line_end(f.base_name, low, f.size)

    def offset(self, start: dict, most: int | None = None) -> dict:
        """The last place that can be read to, or the first line's end at which most bytes are taken."""
        files = self.listed()
        end, left = start, most
        for name, low, high in self.ends(files, start):
            if left is not None and high - low > left:
                high = self.line_end_from(name, low + left, high)
                return {"file": name, "at": high, "files": sum(f.base_name <= name for f in files)}
            end = {"file": name, "at": high, "files": sum(f.base_name <= name for f in files)}
            left = None if left is None else left - (high - low)
            if left == 0:
                break
        return end

    def splits(self, start: dict, end: dict) -> list[Split]:
        files = [f for f in self.listed() if f.base_name <= end["file"]]
        before = sum(f.base_name <= start["file"] for f in files)
        if before > start["files"]:
            raise ValueError(f"{self.path}: {before - start['files']} files appeared before {start['file']}, which is read already")
        out = []
        for f in files:
            if f.base_name >= start["file"]:
                low = start["at"] if f.base_name == start["file"] else 0
                high = end["at"] if f.base_name == end["file"] else f.size
                out += [Split(f.base_name, a, min(a + self.split, high), a == low) for a in range(low, high, self.split)]
        return out

    def lines(self, part: Split) -> Iterator[tuple[int, bytes]]:
        """Lines that start in the split, each with its place."""
        with self.opened(part.file) as f, io.BufferedReader(f, BLOCK) as lines:
            at = part.start
            if not part.aligned:
                lines.seek(at - 1)
                at += len(lines.readline()) - 1
            else:
                lines.seek(at)
            while at < part.end and (line := lines.readline()):
                yield at, line
                at += len(line)

    def batch(self, part: Split, rows: list[tuple[int, bytes]], modified) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(f"{part.file}:{at}".encode()).hexdigest() for at, _ in rows]),
                pa.array([self.kind] * n),
                pa.array([self.host] * n),
                pa.array([line.rstrip(b"\n").removesuffix(b"\r").decode(errors="replace") for _, line in rows]),
                pa.array([modified] * n, pa.timestamp("us", "UTC")),
                pa.array([[]] * n, pa.list_(pa.string())),
                pa.array([0] * n, pa.int32()),
            ],
            names=[c.split()[0] for c in RAW.split(", ")],
        )

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        modified = self.files.get_file_info(f"{self.path}/{part.file}").mtime
        rows, size = [], 0
        for row in self.lines(part):
            rows.append(row)
            size += len(row[1]) + 64
            if size >= BATCH_BYTES:
                yield self.batch(part, rows, modified)
                rows, size = [], 0
        if rows:
            yield self.batch(part, rows, modified)


class Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = Folder(options)

    def partitions(self) -> list[Split]:
        """All lines, the unended last one too."""
        files = self.folder.listed()
        return self.folder.splits(START, {"file": files[-1].base_name, "at": files[-1].size}) if files else []

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition) if partition else iter(())


class Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = Folder(options)
        self.most = int(options["bytesPerTrigger"]) if "bytesPerTrigger" in options else None
        if self.most is not None and (self.most < 1 or "planned" not in options):
            raise ValueError("bytesPerTrigger is at least 1 and needs planned, a file that holds the offset handed out last")
        self.ledger = fs.FileSystem.from_uri(options["planned"]) if self.most else None

    def planned(self) -> dict:
        files, path = self.ledger
        if not files.get_file_info(path).is_file:
            return START
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def plan(self, offset: dict) -> None:
        files, path = self.ledger
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(offset).encode())
        files.move(f"{path}.new", path)

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        if not self.most:
            return self.folder.offset(START)
        offset = self.folder.offset(self.planned(), self.most)
        self.plan(offset)
        return offset

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.folder.splits(start, end)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    metadata = Metadata("log_lines", "1.0.0", "file", "lines of growing files", frozenset({"streaming", "batch", "reconnect", "backpressure"}))

    @classmethod
    def name(cls) -> str:
        return cls.metadata.name

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)


def register(spark: SparkSession, source: type[DataSource] = LogLines) -> frozenset[str]:
    """Makes the source known to the session; what it is capable of."""
    spark.dataSource.register(source)
    return source.metadata.capabilities
