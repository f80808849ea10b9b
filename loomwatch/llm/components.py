"""Connected components by contraction: nothing of it passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.common import join_counted, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b).

    Each round points every node to its smallest neighbour where that is smaller, follows the pointers twice,
    and replaces the ends of the links by what they point to; links within a node go. A star, however large,
    takes two rounds and a chain shrinks to less than a quarter each round; busy nodes join by broadcast, so that
    a star does not end in one task. Null ends and loops are left out.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"), F.count("*").alias("degree")).withColumnRenamed("a", "node"), "pointers")
        for _ in range(2):
            pointed = point.groupBy("to").agg(F.count("*").alias("from"))
            further = pointed.join(point.select(F.col("node").alias("to"), F.col("to").alias("onto")), "to")
            point = written(join_counted(point, further, ["to"], "from").select("node", F.col("onto").alias("to"), "degree"), "pointers")
        steps.append(point)
        for end in ("a", "b"):
            edges = join_counted(edges, point.withColumnRenamed("node", end), [end], "degree").drop(end, "degree").withColumnRenamed("to", end)
        edges = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[-1].select("node", "to")
    for point in reversed(steps[:-1]):
        pointed = point.groupBy("to").agg(F.count("*").alias("from"))
        further = pointed.join(found.select(F.col("node").alias("to"), F.col("to").alias("onto")), "to", "left").withColumn("onto", F.coalesce("onto", "to"))
        found = written(join_counted(point, further, ["to"], "from").select("node", F.col("onto").alias("to")), "pointers")
    return found.select("node", F.col("to").alias("component"))
