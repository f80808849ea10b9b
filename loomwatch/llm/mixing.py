"""Mixing sources to target weights by subset-sum budget fitting.

Targets are shares of all words by weight, each at most a multiple of its source; the excess is reshared.
A source whose target reaches its size is taken whole as often as that goes. For what remains, its documents
are counted by exact length; a bounded-knapsack dynamic program over those counts says how many documents of
each length make up the budget, and that many are selected in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwatch.llm.common import WORD, buckets_for, ranked, same_keys, table, written

WEIGHTS = (5, 2, 1)
#: The dynamic program runs over sums up to twice this; what exceeds it is first filled longest first.
RESERVE = 1 << 16


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target from source, source_size: one row per source, so one task takes them all.

    With the sources by cap over weight, those before the first that stays below its cap are full and the
    others share what is left by weight.
    """
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    shared = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("full")) / F.col("rest"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    )
    return shared.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of the counts to take of each size so that their sum comes as near below budget as it can.

    filled() as long as it comes within a thousandth, or the program sees the whole budget. A source of few very long documents may need
    other ones than the longest: then the program runs over all sums in coarser units, and filled() over what is left, and the better one counts.
    """
    first = filled(sizes, counts, budget)
    if budget <= 2 * RESERVE or 1000 * (min(budget, int((sizes * counts).sum())) - int((sizes * first).sum())) <= budget:
        return first
    coarse = coarse_reach(sizes, counts, budget, -(-budget // (2 * RESERVE)))
    second = coarse + filled(sizes, counts - coarse, budget - int((sizes * coarse).sum()))
    return max(first, second, key=lambda taken: int((sizes * taken).sum()))


def reach(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The bounded knapsack: how many of each size make the largest sum up to budget, counts going in as powers of two."""
    taken, reached, by = np.zeros_like(counts), np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int32)
    reached[0] = True
    steps: list[tuple[int, int]] = []  # (size index, documents at once)
    for i in np.argsort(-sizes, kind="stable"):
        free, k = min(int(counts[i]), budget // int(sizes[i])), 1
        while free > 0 and not reached[budget]:
            k_now, free = min(k, free), free - min(k, free)
            w = k_now * int(sizes[i])
            fresh = np.flatnonzero(reached[: budget + 1 - w] & ~reached[w:]) + w
            reached[fresh], by[fresh] = True, len(steps)
            steps.append((i, k_now))
            k *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = steps[by[at]]
        taken[i] += k
        at -= k * int(sizes[i])
    return taken


def coarse_reach(sizes: np.ndarray, counts: np.ndarray, budget: int, unit: int) -> np.ndarray:
    """reach() with one sum for each unit of the budget, the first that gets there; sums stay exact."""
    taken, sums, by = np.zeros_like(counts), np.full(budget // unit + 1, -1, np.int64), np.full(budget // unit + 1, -1, np.int32)
    sums[0] = 0
    steps: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        free, k = min(int(counts[i]), budget // int(sizes[i])), 1
        while free > 0 and sums[-1] != budget:
            k_now, free = min(k, free), free - min(k, free)
            to = sums[(sums >= 0) & (sums <= budget - k_now * int(sizes[i]))] + k_now * int(sizes[i])
            to = to[sums[to // unit] < 0]
            at, first = np.unique(to // unit, return_index=True)
            sums[at], by[at] = to[first], len(steps)
            steps.append((i, k_now))
            k *= 2
    left = int(sums.max())
    while left:
        i, k = steps[by[left // unit]]
        taken[i] += k
        left -= k * int(sizes[i])
    return taken


def filled(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """First the same share of every size, then whole documents longest first until the rest is small, then reach() over the counts that are left."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts.astype(object) * budget // total).astype(np.int64)
    left = budget - int((taken * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        more = min(int(counts[i] - taken[i]), max(0, left - (RESERVE if sizes[i] <= RESERVE else 0)) // int(sizes[i]))
        taken[i] += more
        left -= more * int(sizes[i])
    return taken + reach(sizes, counts - taken, min(left, 2 * RESERVE))


def choose(group: pd.DataFrame) -> pd.DataFrame:
    sizes = group["size"].to_numpy(np.int64)
    return group[["source", "size"]].assign(extra=fit(sizes, group["n"].to_numpy(np.int64), int(group["budget"].iloc[0])))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 17) -> DataFrame:
    """The documents with size, source_size, target and copies: how often the mix takes each, at most ``most`` times.

    Sources come by code point, null last as a source of its own; the weights repeat. Null and empty texts
    have size 0 and no copies. Repeated rows count each; rows without doc_id take part like any other. The
    same table gives the same mix. Columns named like the added ones are replaced. An empty table stays empty.
    """
    added = ["size", "source_size", "target", "copies"]
    docs = documents.drop(*added).withColumn("size", words_in(F.col("text")))
    return mixed(docs, weights, most, seed)


def mixed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """mix() for rows that have their size."""
    counted = written(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sizes, weights, most).withColumn("__base", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0))
    goals = written(goals.withColumn("budget", F.round(F.col("target") - F.col("__base") * F.col("source_size")).cast("long")), "goals")
    of = goals.withColumnRenamed("source", "goal_source")
    lengths = counted.join(of, same_keys(["source"], ["goal_source"])).drop("goal_source")
    extra = lengths.where("size > 0").select("source", "size", "n", "budget").groupBy("source").applyInPandas(choose, "source string, size long, extra long")
    extra = extra.withColumnsRenamed({"source": "x_source", "size": "x_size"})
    chosen = lengths.join(extra, same_keys(["source", "size"], ["x_source", "x_size"]), "left").select(
        "source", "size", "source_size", "target", "__base", F.coalesce("extra", F.lit(0)).alias("__extra")
    )
    rows = counted.agg(F.sum("n")).first()[0] or 0
    seeded = docs.withColumn("__h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    ranks = ranked(seeded, ["source", "size"], ["__h", "doc_id"], buckets_for(rows), "__rank", written(chosen, "chosen"))
    copies = F.when(F.col("size") > 0, F.col("__base") + (F.col("__rank") < F.col("__extra")).cast("long")).otherwise(0).cast("long")
    return ranks.withColumn("copies", copies).drop("__h", "__rank", "__base", "__extra")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    mixture = mixed(written(docs, "sizes"), WEIGHTS, 3, 17)
    return mixture.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
