"""Text search by a written index of trigrams: posting lists are met before any text is read.

The index has three tables, all sorted so that a scan touches few row groups: the texts by id, the posting lists
(gram, id), and how many rows each gram has. A fourth, lists of each row's grams, is only there to write the second. A search looks up the counts of its grams, meets the posting lists of
the rarest few, and reads only the rows that are left, which it then tests for the text itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Posting lists that are met; more of them leave hardly fewer rows.
RAREST = 4
#: Ids that are pushed down to the scan as a list; beyond that the texts are joined.
LISTED = 1000
#: Bytes of a row group of the posting lists and texts.
ROW_GROUP = 1 << 20


def grams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text, as numbers; none for shorter texts."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(starts, lambda i: F.crc32(F.substring(low, i, F.lit(3)).cast("binary"))))


@dataclass(frozen=True)
class TextIndex:
    """An index under a path over the column text of rows that the column id tells apart."""

    path: str
    id: str = "id"
    text: str = "text"

    def write(self, rows: DataFrame) -> None:
        """Writes the index anew. Rows without text or id are not in it. A gram of many rows spreads over tasks by id.

        Lists of grams are written before they are dealt by range, which looks at its rows twice: once for the bounds.
        """
        kept = rows.where(F.col(self.id).isNotNull() & F.col(self.text).isNotNull())
        sorted_by = lambda df, *c: df.repartitionByRange(*c).sortWithinPartitions(*c).write.mode("overwrite").option("parquet.block.size", ROW_GROUP)
        sorted_by(kept, self.id).parquet(f"{self.path}/texts")
        listed = rows.sparkSession.read.parquet(f"{self.path}/texts").select(self.id, grams(F.col(self.text)).alias("gram"))
        listed.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/lists")
        posted = rows.sparkSession.read.parquet(f"{self.path}/lists").select(F.explode("gram").alias("gram"), self.id)
        sorted_by(posted, "gram", self.id).parquet(f"{self.path}/postings")
        counted = rows.sparkSession.read.parquet(f"{self.path}/postings").groupBy("gram").agg(F.count("*").alias("rows"))
        sorted_by(counted, "gram").parquet(f"{self.path}/grams")

    def rarest(self, spark: SparkSession, value: str) -> list[int] | None:
        """The grams to meet; None if the value has none, empty if one of them is in no text."""
        parts = [p for p in re.split(r"[%_]", value) if len(p) >= 3]  # wildcards of LIKE part it
        if not parts:
            return None
        wanted = {g for (own,) in spark.createDataFrame([(p,) for p in parts], "p string").select(grams(F.col("p"))).collect() for g in own}
        found = spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(sorted(wanted))).orderBy("rows", "gram").collect()
        return [r["gram"] for r in found[:RAREST]] if len(found) == len(wanted) else []

    def candidates(self, spark: SparkSession, chosen: list[int]) -> DataFrame:
        """The ids that have all of the grams."""
        met = spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(chosen))
        return met.groupBy(self.id).agg(F.count("*").alias("__n")).where(F.col("__n") == len(chosen)).select(self.id)

    def search(self, spark: SparkSession, value: str) -> DataFrame:
        """The rows whose text contains the value, case aside, with % and _ as in LIKE. Values without three characters in a row are looked for in all texts."""
        texts = spark.read.parquet(f"{self.path}/texts")
        hit = F.col(self.text).ilike(f"%{value}%")
        chosen = self.rarest(spark, value)
        if chosen is None:
            return texts.where(hit)
        if not chosen:
            return texts.limit(0)
        ids = self.candidates(spark, chosen)
        some = [r[0] for r in ids.limit(LISTED + 1).collect()]
        if len(some) <= LISTED:
            return texts.where(F.col(self.id).isin(some) & hit)
        return texts.where(hit).join(ids, self.id, "left_semi")
