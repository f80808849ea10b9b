"""A keyed store of micro-batches on plain Parquet folders: a lookup reads the buckets of its keys, whatever the store's age.

Each micro-batch is a folder whose rows lie in buckets of their keys' hash; the more rows a folder has, the more
buckets. Folders of like size are merged four by four, so there are few of them, however many micro-batches came.
A manifest, one file a version, names the folders that count. It is written last, and a micro-batch that is retried
starts from the version before it: what a failed attempt left is overwritten or never named.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a size that are merged, versions of the manifest that are kept for readers.
MERGE, KEEP = 4, 8


@dataclass(frozen=True)
class Folder:
    path: str
    bits: int
    rows: int


class Buckets:
    """Rows of a schema by key columns under a path. ``each`` is about how many rows a bucket has."""

    def __init__(self, path: str, keys: list[str], schema: str, each: int = 20_000):
        self.path, self.keys, self.schema, self.each = path.rstrip("/"), keys, StructType.fromDDL(schema), each

    def bucket(self, bits: int) -> Column:
        return F.xxhash64(*self.keys).bitwiseAND((1 << bits) - 1).cast("int")

    def files(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self, spark: SparkSession) -> list[int]:
        fs, path = self.files(spark)
        at = path(f"{self.path}/_manifest")
        return sorted(int(s.getPath().getName().removeprefix("version=")) for s in fs.listStatus(at)) if fs.exists(at) else []

    def folders(self, spark: SparkSession, before: int | None = None) -> list[Folder]:
        """Those of the last version, or of the last one before a micro-batch."""
        found = [v for v in self.versions(spark) if before is None or v < before]
        rows = spark.read.text(f"{self.path}/_manifest/version={found[-1]}").collect() if found else []
        return [Folder(**json.loads(r["value"])) for r in rows]

    def read(self, spark: SparkSession, folders: list[Folder]) -> DataFrame:
        out = spark.createDataFrame([], self.schema)
        for f in folders:
            out = out.unionByName(spark.read.schema(self.schema).parquet(f"{self.path}/{f.path}").select(*self.schema.names))
        return out

    def all(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, self.folders(spark))

    def lookup(self, wanted: DataFrame, batch: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys of wanted fall into, as the store was before the micro-batch; others of these buckets too.

        Bucket numbers go through the driver, at most one for each of wanted's keys. Folders are listed whole only
        if many of their buckets are wanted.
        """
        spark = wanted.sparkSession
        folders = self.folders(spark, batch)
        bits = max((f.bits for f in folders), default=0)
        hit = {r[0] for r in wanted.select(self.bucket(bits)).distinct().collect()} if bits else {0}
        fs, path = self.files(spark)
        out = spark.createDataFrame([], self.schema)
        for f in folders:
            some = sorted({b & ((1 << f.bits) - 1) for b in hit})
            at = f"{self.path}/{f.path}"
            reader = spark.read.schema(self.schema).option("basePath", at)
            if 4 * len(some) < 1 << f.bits:
                there = [p for p in (f"{at}/bucket={b}" for b in some) if fs.exists(path(p))]
                rows = reader.parquet(*there) if there else None
            else:
                rows = reader.parquet(at).where(F.col("bucket").isin(some))
            if rows is not None:
                out = out.unionByName(rows.select(*self.schema.names))
        return out

    def write(self, rows: DataFrame, path: str, n: int) -> Folder:
        bits = max(0, (n // self.each).bit_length())
        rows.select(*self.schema.names, self.bucket(bits).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{path}")
        return Folder(path, bits, n)

    def append(self, rows: DataFrame, batch: int) -> None:
        """The rows of a micro-batch, whose keys the store does not have; a retry with the same number replaces them."""
        spark, n = rows.sparkSession, rows.count()
        folders = self.folders(spark, batch)
        if n:
            folders.append(self.write(rows, f"batch={batch}", n))
        size = lambda f: max(0, (f.rows // self.each).bit_length() // 2)
        tier = 0
        while tier <= max((size(f) for f in folders), default=-1):
            like = [f for f in folders if size(f) == tier]
            if len(like) >= MERGE:
                merged = self.write(self.read(spark, like), f"_merged/batch={batch}-{tier}", sum(f.rows for f in like))
                folders = [f for f in folders if f not in like] + [merged]
            tier += 1
        lines = spark.createDataFrame([(json.dumps(asdict(f)),) for f in folders], "value string")
        lines.coalesce(1).write.mode("overwrite").text(f"{self.path}/_manifest/version={batch}")
        self.vacuum(spark)

    def vacuum(self, spark: SparkSession) -> None:
        """Deletes versions but the last few, and the folders of dropped versions that no kept one names."""
        fs, path = self.files(spark)
        versions = self.versions(spark)
        named = {v: {f.path for f in self.folders(spark, v + 1)} for v in versions[-KEEP - 2 :]}
        kept = set().union(*(named[v] for v in versions[-KEEP:]))
        for v in versions[:-KEEP]:
            for p in named.get(v, set()) - kept:
                fs.delete(path(f"{self.path}/{p}"), True)
            fs.delete(path(f"{self.path}/_manifest/version={v}"), True)
