"""What the corpus operators share: the shared folder, written tables and ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of rows that go to Python at once: ten thousand whole texts could be any number of bytes.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds batches for Python by bytes where the session has no bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="loomwatch-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/loomwatch/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def same_keys(left: list[str], right: list[str]) -> Column:
    """Equality of the columns in pairs, null equal to null."""
    found = F.lit(True)
    for a, b in zip(left, right, strict=True):
        found = found & F.col(a).eqNullSafe(F.col(b))
    return found


def buckets_for(rows: int, each: int = 50_000) -> int:
    """How many buckets a group of so many rows may need, a power of two from 64."""
    return 1 << max(6, (rows // each).bit_length())


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, most: int = 1024) -> DataFrame:
    """Inner join with right, which has every key once and in ``count`` how many rows of left have it.

    The ``most`` keys with most rows join by broadcast where their rows lie, so a key that is shuffled has at most
    its 1024th part of them. left is read twice and best a written table; rows of right that count more than once must be narrow.
    """
    busy = right.where(F.col(count) > 1).orderBy(F.desc(count), *on).limit(most)
    quiet = left.join(F.broadcast(busy.select(*on)), on, "left_anti").join(right, on)
    return left.join(F.broadcast(busy), on).unionByName(quiet)


#: Rows of a few numbers each that are broadcast: about 40 MB of a task's memory.
FEW = 1 << 20


def few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The narrow rows, marked for broadcast if they are at most ``most``; they are counted, so best a written table. Beyond that both sides are shuffled."""
    return F.broadcast(rows) if rows.count() <= (FEW if most is None else most) else rows


def tasks_for(groups: int, rows: int) -> int:
    """Tasks for groups that are few bytes but much work: several a group, so that few share one, and no more than the rows need."""
    return min(4 * groups, max(64, rows // 256))


def ranked(df: DataFrame, keys: list[str], order: list[str], buckets: int = 64, out: str = "rank", attach: DataFrame | None = None) -> DataFrame:
    """Adds each row's rank (from 0) among the rows of its keys, without bringing a key's rows to one task.

    Rows are dealt to buckets by a hash of the order columns, and a key's buckets follow one another: a rank
    is the number of the key's rows in earlier buckets plus the place within the bucket. Null keys count as
    keys of their own; rows that tie in all order columns take adjacent ranks. ``attach`` has the columns of
    keys, once each, and more that are added to the key's rows.
    """
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)).cast("int"))
    inner = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__k{i}" for i in range(len(keys))]
    offsets = (
        dealt.groupBy(*keys, "__b").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__b").alias("__kb"), "__before")
    )
    more = []
    if attach is not None:
        more = [c for c in attach.columns if c not in keys]
        others = [f"__a{i}" for i in range(len(keys))]
        offsets = offsets.join(attach.withColumnsRenamed(dict(zip(keys, others, strict=True))), same_keys(names, others), "left").drop(*others)
    joined = inner.join(offsets, same_keys([*keys, "__b"], [*names, "__kb"]))
    return joined.withColumn(out, F.col("__before") + F.col("__n") - 1).select(*df.columns, out, *more)
