"""Extension points: parsers (one row to many, also as table functions of SQL), analyzers (event to alerts), exporters and hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


@dataclass
class Plugins:
    """parsers and analyzers turn a batch of rows into any number of rows; exporters take whole micro-batches."""

    parsers: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = field(default_factory=dict)
    analyzers: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = field(default_factory=dict)
    exporters: dict[str, Callable[[DataFrame, int], None]] = field(default_factory=dict)

    def parse(self, name: str, raw: DataFrame) -> DataFrame:
        return expanded(raw, *self.parsers[name])

    def analyze(self, name: str, events: DataFrame) -> DataFrame:
        return expanded(events, *self.analyzers[name])

    def export(self, df: DataFrame, batch: int) -> dict[str, str]:
        """Each exporter on its own: the outcome of one does not stop the others. For foreachBatch."""
        outcome = {}
        for name, run in self.exporters.items():
            try:
                run(df, batch)
                outcome[name] = "exported"
            except Exception as error:  # noqa: BLE001
                outcome[name] = f"failed: {error}"
        return outcome


def expanded(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(out := function(batch)):
                yield out

    return rows.mapInPandas(run, schema)


# ---- parsers as table functions of SQL


def octet_counted(payload: str) -> Iterator[tuple[int, str]]:
    """The messages of a frame, each behind its length in bytes and a space; what follows a broken length is one message."""
    data, at, n = payload.encode(), 0, 0
    while at < len(data):
        digits = data[at : at + 10].split(b" ", 1)
        size = int(digits[0]) if len(digits) == 2 and digits[0].isdigit() else None
        start = at if size is None else at + len(digits[0]) + 1
        end = len(data) if size is None or start + size > len(data) else start + size
        yield n, data[start:end].decode(errors="replace")
        at, n = end, n + 1


def line_split(payload: str) -> Iterator[tuple[int, str]]:
    """The lines that are not blank."""
    yield from enumerate(x for x in payload.splitlines() if x.strip())


PARSERS: dict[str, Callable[[str], Iterator[tuple[int, str]]]] = {"octet_counted": octet_counted, "line_split": line_split}


def register_parsers(spark: SparkSession, parsers: dict[str, Callable[[str], Iterator[tuple]]] = PARSERS, schema: str = "position int, message string") -> None:
    """Each parser as a table function: SELECT r.*, p.* FROM raw r, LATERAL octet_counted(r.payload) p.

    A null payload has no rows. A payload on which the parser fails has none of the parser's columns but the error,
    with the rows before it: one bad payload does not stop the others.
    """
    for name, parser in parsers.items():
        spark.udtf.register(name, udtf(_table_function(parser, len(schema.split(","))), returnType=f"{schema}, error string", useArrow=True))


def _table_function(parser: Callable[[str], Iterator[tuple]], width: int) -> type:
    class Parse:
        def eval(self, payload: str):
            if payload is None:
                return
            try:
                for row in parser(payload):
                    yield (*row, None)
            except Exception as error:  # noqa: BLE001
                yield (*[None] * width, f"{type(error).__name__}: {error}")

    return Parse


class Stitch:
    """Lines that start with a blank belong to the message before them: a table function over ordered partitions.

    SELECT * FROM stitched(TABLE(lines) PARTITION BY (host, day) ORDER BY place): rows need columns id (bigint) and
    line. A continuation at the start of a partition is a message of its own. Only one message is held at a time.
    """

    def __init__(self) -> None:
        self.first, self.parts = None, []

    def eval(self, row):
        line = row["line"] or ""
        if self.parts and line[:1] in (" ", "\t"):
            self.parts.append(line)
            return
        if self.parts:
            yield self.first, len(self.parts), "\n".join(self.parts)
        self.first, self.parts = row["id"], [line]

    def terminate(self):
        if self.parts:
            yield self.first, len(self.parts), "\n".join(self.parts)


def register_stitched(spark: SparkSession, name: str = "stitched") -> None:
    spark.udtf.register(name, udtf(Stitch, returnType="id bigint, n_lines int, message string"))
