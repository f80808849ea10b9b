"""What changed between two versions of a table, and hooks that are told of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CREATED, UPDATED, STATUS_CHANGED, DELETED = "created", "updated", "status_changed", "deleted"


def changes(before: DataFrame, after: DataFrame, key: str, status: str = "status") -> DataFrame:
    """key, change, from_status, to_status of the rows that differ: created, deleted, status_changed, or updated in any other column.

    Keys are unique within a version. Rows are compared by a hash of all columns by name, so order and added columns
    that are null in both don't matter; a column that only one version has counts as null in the other.
    """
    names = sorted({*before.columns, *after.columns} - {key})

    def hashed(df: DataFrame, side: str) -> DataFrame:
        parts = [F.coalesce(F.to_json(F.struct(F.col(n).alias("v"))) if n in df.columns else F.lit("{}"), F.lit("{}")) for n in names]
        state = F.col(status).cast("string") if status in df.columns else F.lit(None).cast("string")
        return df.select(F.col(key).alias(f"{side}_key"), F.sha2(F.concat_ws("\n", *parts), 256).alias(f"{side}_hash"), state.alias(f"{side}_status"))

    both = hashed(before, "from").join(hashed(after, "to"), F.col("from_key") == F.col("to_key"), "full_outer")
    change = (
        F.when(F.col("from_key").isNull(), CREATED).when(F.col("to_key").isNull(), DELETED)
        .when(~F.col("from_status").eqNullSafe(F.col("to_status")), STATUS_CHANGED).when(F.col("from_hash") != F.col("to_hash"), UPDATED)
    )
    return both.select(F.coalesce("to_key", "from_key").alias(key), change.alias("change"), "from_status", "to_status").where("change is not null")


class Hooks:
    """Functions by kind of change; each gets the rows of its kind. run() is for foreachBatch and for two versions alike."""

    def __init__(self) -> None:
        self.held: list[tuple[str, str, Callable[[DataFrame, int], None]]] = []

    def on(self, change: str, name: str, run: Callable[[DataFrame, int], None]) -> Hooks:
        self.held.append((change, name, run))
        return self

    def run(self, found: DataFrame, batch: int = 0) -> dict[str, str]:
        """What became of each hook; one that fails does not stop the others."""
        outcome, held = {}, found.persist()
        for change, name, run in self.held:
            try:
                run(held.where(F.col("change") == change), batch)
                outcome[name] = "done"
            except Exception as error:  # noqa: BLE001
                outcome[name] = f"failed: {error}"
        held.unpersist()
        return outcome
