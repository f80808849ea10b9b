"""Nearest neighbours over randomly rotated one-bit codes.

A vector becomes, relative to its chunk's centre, a unit vector that is rotated at random; the code is the
sign of each coordinate, packed, with two correction scalars: the distance to the centre and the inner
product of code and vector. The inner product of code and rotated query, divided by the latter scalar,
estimates that of vector and query, within a bound that shrinks with the dimension. Codes are made once and
gone through twice: first the vectors that each chunk estimates to be nearest tell how far a query's nearest
can be at most; then all vectors whose bound does not exclude them within that distance are reranked on the
original vectors.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwatch.llm.common import table, tasks_for, written

#: Rows of a chunk of the index and queries of a block: what meets in one group.
CHUNK, BLOCK = 4096, 4096
#: Width of the error bound in standard deviations of the estimate, and least bits of a code: vectors of fewer dimensions are rotated with zeros behind them.
WIDTH, BITS = 4.0, 512


def usable(vector: Column) -> Column:
    """Not null, not empty or zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(4)
def rotation(dimension: int, bits: int, seed: int = 5) -> np.ndarray:
    """What turns vectors of the dimension, zeros behind them, at random."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimension]


class Codes:
    """One-bit codes of vectors (rows) with their correction scalars."""

    def __init__(self, vectors: np.ndarray):
        self.dimension, self.centre = vectors.shape[1], vectors.mean(0)
        self.bits = max(self.dimension, BITS)
        moved = vectors - self.centre
        self.norms = np.linalg.norm(moved, axis=1)
        turned = moved / np.maximum(self.norms, 1e-300)[:, None] @ rotation(self.dimension, self.bits)
        self.packed = np.packbits(turned > 0, axis=1)
        self.aligned = np.maximum(np.abs(turned).sum(1) / np.sqrt(self.bits), 1e-9)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances of all vectors (columns) to the queries (rows), and what they can be at least."""
        moved = queries - self.centre
        lengths = np.linalg.norm(moved, axis=1)
        turned = (moved / np.maximum(lengths, 1e-300)[:, None] @ rotation(self.dimension, self.bits)).astype(np.float32)
        # With bits as 0 and 1 the sum over signs is twice that over set bits less that over all.
        bits = np.unpackbits(self.packed, axis=1, count=self.bits).astype(np.float32)
        product = (2 * (turned @ bits.T) - turned.sum(1)[:, None]) / np.float32(np.sqrt(self.bits)) / self.aligned.astype(np.float32)
        error = np.sqrt(np.maximum(0, 1 - self.aligned**2)) / self.aligned * WIDTH / np.sqrt(max(1, self.bits - 1))
        both, cross = self.norms**2 + (lengths**2)[:, None], 2 * self.norms * lengths[:, None]
        return both - cross * product, both - cross * np.minimum(1, product + error)


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum((vectors - query) ** 2, axis=1)[:, -1])


def nearest(queries: np.ndarray, own: np.ndarray, within: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query ids and distances of its k nearest but its own, ties to the smaller id, and how many were reranked.

    ``within`` is how far the nearest can be at most; where it is infinite, only the k that are estimated nearest are reranked.
    """
    out = []
    for at in range(0, len(queries), 256):
        estimate, least = codes.bounds(queries[at : at + 256])
        for query, me, most, estimated, bound in zip(queries[at : at + 256], own[at : at + 256], within[at : at + 256], estimate, least, strict=True):
            if np.isinf(most):
                estimated[ids == me] = np.inf
                chosen = np.argpartition(estimated, min(k, len(ids)) - 1)[:k]
            else:
                chosen = np.flatnonzero(bound <= most**2 * (1 + 1e-6))
            chosen = chosen[ids[chosen] != me]
            scores = distances(query, vectors[chosen].astype(np.float64)) if len(chosen) else np.empty(0)
            best = np.lexsort((ids[chosen], scores))[:k]
            out.append((ids[chosen][best], scores[best], len(chosen)))
    return out


def top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


FOUND = "query_id long, vec_id long, score double, reranked long"


def reranked(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, score, reranked: of each chunk the k nearest to each query and how many of it were reranked (in its first row)."""
    good = vectors.where("vec_id is not null").where(usable(F.col("embedding"))).select("vec_id", "embedding")
    asked = queries.where("query_id is not null").where(usable(F.col("embedding"))).select("query_id", "embedding").dropDuplicates(["query_id"])
    rows, n = good.count(), asked.count()
    chunks, blocks = -(-max(1, rows) // CHUNK), -(-max(1, n) // BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("vec_id")
        exact = np.stack(group["embedding"].to_list())
        held = pickle.dumps((group["vec_id"].to_numpy(), exact, Codes(exact.astype(np.float64))))
        return pd.DataFrame({"chunk": [key[0]], "dims": [key[1]], "codes": [held]})

    tasks = tasks_for(chunks * blocks, rows)
    dealt = good.select("vec_id", "embedding", deal("vec_id", chunks).alias("chunk"), F.size("embedding").alias("dims"))
    index = written(dealt.repartition(tasks_for(chunks, rows), "chunk").groupBy("chunk", "dims").applyInPandas(make, "chunk int, dims int, codes binary"), "codes")
    index = index.withColumn("block", every(blocks)).repartition(tasks, "chunk", "dims", "block")

    def meet(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "reranked": []})]
        if len(index) and len(wanted):
            ids, held, codes = pickle.loads(index["codes"].iloc[0])
            asked = np.stack(wanted["embedding"].to_list()).astype(np.float64)
            own = wanted["query_id"].to_numpy()
            for q, (found, scores, n) in zip(own, nearest(asked, own, wanted["within"].to_numpy(np.float64), ids, held, codes, k), strict=True):
                out.append(pd.DataFrame({"query_id": q, "vec_id": found, "score": scores, "reranked": np.where(np.arange(len(found)) == 0, n, 0)}))
        return pd.concat(out)

    def searched(asked: DataFrame) -> DataFrame:
        sent = asked.select("query_id", "embedding", "within", F.size("embedding").alias("dims"), deal("query_id", blocks).alias("block"), every(chunks).alias("chunk"))
        sent = sent.repartition(tasks, "chunk", "dims", "block")
        return index.groupBy("chunk", "dims", "block").cogroup(sent.groupBy("chunk", "dims", "block")).applyInPandas(meet, FOUND)

    first = top(written(searched(asked.withColumn("within", F.lit(float("inf")))), "first"), k)
    limits = written(first.groupBy("query_id").agg(F.max("score").alias("of"), F.count("*").alias("n")), "limits")
    # Fewer than k candidates at all: each of them was reranked, and any distance will do.
    within = F.when(F.col("n") >= k, F.col("of")).otherwise(F.lit(1e150))
    return searched(asked.join(limits, "query_id").withColumn("within", within).drop("of", "n"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of vectors (vec_id, embedding) to each query (query_id, embedding).

    Chunks of vectors meet blocks of queries, so no group grows with the table and nothing goes through the
    driver. Unusable vectors (see usable) and null ids take no part; rows with the query's id are its own;
    repeated ids count once. Vectors compare only with those of their dimension. Fewer than k candidates give
    fewer rows; an empty table gives none.
    """
    return top(reranked(vectors, queries, k), k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


SQL = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), d as (
  select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 100 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score, vec_id) as rank, vec_id, score from d
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
