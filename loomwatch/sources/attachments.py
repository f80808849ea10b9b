"""Attachments of cases: contents by their hash, written once, and entries that refer to them.

A content is a row (sha256, size, content) below folder/contents; a batch has a folder of its own there, which a retry
overwrites. Contents lie where their files were read, so that writing them neither shuffles nor splits them up. Cases and lists hold hash and size only: contents are
read where they are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.functions.keys import filled

CONTENT = "sha256 string, size long, content binary"
ENTRY = ("case_id", "ts", "name", "content_type", "size", "sha256", "url", "added_by")


def files(spark: SparkSession, path: str, glob: str = "*", stream: bool = False) -> DataFrame:
    """Files below the path: id (the path), name, content, ts (time of change). Spark's reader leaves out files without a byte."""
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = reader.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("modificationTime").alias("ts"))


def hashed(files: DataFrame) -> DataFrame:
    """Adds sha256 and size of the content; rows without content have neither."""
    return files.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content").cast("long")})


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """What is stored; a hash that two batches wrote at the same time may be there twice, with the same content."""
    return spark.read.schema(f"{CONTENT}, batch string").option("basePath", f"{folder}/contents").parquet(f"{folder}/contents/*")


def store(files: DataFrame, folder: str, batch: str, key: str = "id") -> None:
    """Writes those contents of the files (key, content) that no other batch stored yet, each once; a row that repeats with its key is written again.

    Which row writes a content is settled on hashes alone; contents go to no aggregate.
    """
    spark = files.sparkSession
    target = f"{folder}/contents/batch={batch}"
    rows = hashed(files).where("content is not null")
    writers = rows.groupBy("sha256").agg(F.min(key).alias("__key"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/contents")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        others = contents(spark, folder).where(F.col("batch") != batch).select("sha256").distinct()
        writers = writers.join(others, "sha256", "left_anti")
    new = rows.join(writers, (rows[key] == F.col("__key")) & (rows["sha256"] == writers["sha256"]), "left_semi")
    new.select("sha256", "size", "content").write.mode("overwrite").parquet(target)


def entries(files: DataFrame, case_id: Column, content_type: Column | None = None, url: Column | None = None, added_by: Column | None = None) -> DataFrame:
    """Attachment entries of files (name, content, ts); one with a url and no content has size 0 and no hash."""
    rows = hashed(files)
    values = {
        "case_id": case_id, "content_type": content_type if content_type is not None else F.lit(""), "url": url if url is not None else F.lit(""),
        "added_by": added_by if added_by is not None else F.lit("system"), "size": F.coalesce("size", F.lit(0).cast("long")),
    }
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in ENTRY])


def timeline(entries: DataFrame) -> DataFrame:
    """What the entries add to the cases' timelines."""
    return entries.select("case_id", "ts", F.lit("attachment").alias("kind"), F.concat(F.lit("Attachment '"), "name", F.lit("' added")).alias("text"), F.col("added_by").alias("actor"))


def summary(entries: DataFrame) -> DataFrame:
    """Per case: number of attachments, their bytes, different contents, time of the last."""
    return entries.groupBy("case_id").agg(
        F.count("*").alias("attachments"), F.sum("size").alias("bytes"), F.count_distinct(filled(F.col("sha256"))).alias("contents"), F.max("ts").alias("last_added")
    )


def checked(spark: SparkSession, entries: DataFrame, folder: str) -> DataFrame:
    """Adds state to the entries: stored, damaged (hash or size do not fit the content), missing, or link (no hash).

    Contents are hashed where they lie; hashes and verdicts alone are joined.
    """
    sound = (F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size"))
    held = contents(spark, folder).select(F.col("sha256").alias("__sha"), sound.alias("__sound")).groupBy("__sha").agg(F.bool_or("__sound").alias("__sound"))
    state = F.when(F.col("sha256").isNull(), "link").when(F.col("__sound").isNull(), "missing").when(F.col("__sound"), "stored").otherwise("damaged")
    return entries.join(held, F.col("sha256") == F.col("__sha"), "left").withColumn("state", state).drop("__sha", "__sound")


def opened(spark: SparkSession, entries: DataFrame, folder: str) -> DataFrame:
    """The entries with their content."""
    held = contents(spark, folder).select(F.col("sha256").alias("__sha"), "content")
    wanted = entries.where("sha256 is not null").select(F.col("sha256").alias("__want")).distinct()
    one = held.join(wanted, F.col("__sha") == F.col("__want"), "left_semi")
    first = one.groupBy("__sha").agg(F.first("content").alias("content"))
    return entries.join(first, F.col("sha256") == F.col("__sha"), "left").drop("__sha")
