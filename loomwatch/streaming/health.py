"""Progress of streaming queries as health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

# Capabilities that a source may have.
CAPABILITIES = ("streaming", "batch", "reconnect", "backpressure", "rate_limit")


class Reports(StreamingQueryListener):
    """The latest report of each query; a query that fails is offline, one that falls behind degraded."""

    def __init__(self, slow_ms: int = 60_000):
        self.slow_ms, self.held = slow_ms, {}

    def onQueryStarted(self, event) -> None:
        self.held[str(event.id)] = (event.name or "", "online", 0, 0.0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.batchDuration
        self.held[str(p.id)] = (p.name or "", "degraded" if took > self.slow_ms else "online", p.numInputRows, float(took))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name, _, rows, took = self.held.get(str(event.id), ("", "", 0, 0.0))
        self.held[str(event.id)] = (name, "offline" if event.exception else "online", rows, took)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *v) for k, v in self.held.items()]
        return spark.createDataFrame(rows, "query_id string, name string, health string, rows long, batch_ms double")
