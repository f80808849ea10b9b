"""The corpus pipeline: each stage works on all that its predecessor kept and returns the columns of documents, the last one packed pieces.

Of every stage: an empty table stays empty; repeated rows are rows of their own but for near-dedup, where one
stays; columns of any further names are passed through as they are; whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm import common, mixing, packing, quality, secrets, similar


def carrying(docs: DataFrame, needed: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents as they are of the rows that work leaves of the needed columns: names that it adds don't clash with theirs."""
    return work(docs.select(*needed, F.struct(*docs.columns).alias("__row"))).select("__row.*")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; rows without doc_id or lang are judged like others."""
    labels = common.table(spark, sf_dir, "labels")
    return carrying(docs, ("doc_id", "text", "lang"), lambda d: quality.classify(d, labels).where("keep"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: those linked by five-word shingles that are at least 0.8 alike.

    Rows are told apart by a key of their own, not by doc_id: rows that share an id are judged by their texts,
    and the row with the smallest id (then a hash of all columns) stays. Rows without doc_id take no part and stay.
    Null, empty and blank texts have the same shingles, none: they are one group.
    """
    rows = common.written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = similar.groups(rows.where("doc_id is not null").select(F.col("__row").alias("row"), "text"))
    order = rows.select(F.col("__row").alias("row"), F.struct("doc_id", F.xxhash64(*docs.columns).alias("h"), "__row").alias("order"))
    heads = common.written(found.join(order, "row").groupBy("component").agg(F.min("order")["__row"].alias("head"), F.count("*").alias("n")), "heads")
    gone = common.written(common.join_counted(found, heads, ["component"], "n").where("row <> head").select(F.col("row").alias("__row")), "copies")
    return rows.join(common.few(gone), "__row", "left_anti").select(*docs.columns)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay, null and empty texts as they are."""
    return secrets.redacted(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it; null, empty and blank texts have no words and go. A null source is one of its own."""

    def repeated(d: DataFrame) -> DataFrame:
        return mixing.mix(d).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    return carrying(docs, ("doc_id", "text", "source"), repeated)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in the sequences; a repeated document is packed as often."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality_classifier", stage_quality),
    ("simhash_near_dedup", stage_near_dedup),
    ("secret_scan", stage_secrets),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]
#: The classifier, the mixer and the packer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
