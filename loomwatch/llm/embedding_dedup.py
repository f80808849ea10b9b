"""Embedding near-duplicates over navigable small-world graphs, one per shard.

Vectors of a label fall into shards by a hash; each shard gets a hierarchical graph, kept as one row of a
written table. Every vector queries every shard of its label. Where queries meet a shard, a sample of them, of
that shard or another, is audited against brute force: the beam widens until it finds enough of their links
to others, and if the widest does not, the whole shard is compared. A beam that ends among links is widened
too. Links are verified by cosine in double precision; one link per vector and group goes on to the components.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import table, tasks_for, written
from loomwatch.llm.components import components
from loomwatch.llm.neighbours import usable

#: Vectors of a shard, queries that meet a shard in one group, queries looked at for links, those of them audited, and the share of links they must find.
SHARD, PART, LOOKED, AUDIT, RECALL = 8192, 8192, 1024, 64, 0.99
#: Beams, and where none is wide enough the whole shard.
NARROWEST, WIDEST = 16, 256


class Graph:
    """A hierarchical navigable small-world graph of unit vectors, by cosine."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 40, seed: int = 3):
        self.vectors, self.links = vectors, links
        self.levels = np.minimum(-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / math.log(links), 12).astype(int).tolist()
        self.near: list[list[list[int]]] = [[[] for _ in range(n + 1)] for n in self.levels]
        self.entry = 0
        for i in range(1, len(vectors)):
            self.insert(i, beam)
            if self.levels[i] > self.levels[self.entry]:
                self.entry = i

    def climb_down(self, query: np.ndarray, to: int) -> int:
        """Greedy descent from the top to the layer above ``to``."""
        at, vectors = self.entry, self.vectors
        best = float(vectors[at] @ query)
        for layer in range(self.levels[self.entry], to, -1):
            while near := self.near[at][layer]:
                found = vectors[near] @ query
                i = int(found.argmax())
                if found[i] <= best:
                    break
                at, best = near[i], float(found[i])
        return at

    def beam(self, query: np.ndarray, start: int, width: int, layer: int = 0) -> list[tuple[float, int]]:
        """(cosine, vector) of the best ``width`` found, worst first as a heap."""
        vectors, near = self.vectors, self.near
        first = float(vectors[start] @ query)
        seen, open_, best = {start}, [(-first, start)], [(first, start)]
        while open_:
            value, at = heapq.heappop(open_)
            if -value < best[0][0] and len(best) >= width:
                break
            fresh = [x for x in near[at][layer] if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for s, x in zip((vectors[fresh] @ query).tolist(), fresh, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, x))
                    heapq.heappush(open_, (-s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                    heapq.heappush(open_, (-s, x))
        return best

    def spread(self, to: int, found: list[int], most: int) -> list[int]:
        """Nearest first, leaving out what is nearer to one that is kept than to ``to``; filled up with the nearest."""
        held = self.vectors[found]
        own = held @ self.vectors[to]
        order = np.argsort(-own, kind="stable").tolist()
        among, own = (held @ held.T).tolist(), own.tolist()
        kept: list[int] = []
        for i in order:
            row = among[i]
            if all(row[j] < own[i] for j in kept):
                kept.append(i)
                if len(kept) == most:
                    break
        if len(kept) < most // 2:
            kept += [i for i in order if i not in kept][: most // 2 - len(kept)]
        return [found[i] for i in kept]

    def insert(self, i: int, width: int) -> None:
        query, top = self.vectors[i], min(self.levels[i], self.levels[self.entry])
        at = self.climb_down(query, top)
        for layer in range(top, -1, -1):
            found = [x for _, x in self.beam(query, at, width, layer)]
            self.near[i][layer] = chosen = self.spread(i, found, self.links)
            most = self.links * (2 if layer == 0 else 1)
            for x in chosen:
                back = self.near[x][layer]
                back.append(i)
                if len(back) > most:
                    self.near[x][layer] = self.spread(x, back, most)
            at = chosen[0]

    def above(self, query: np.ndarray, least: float, width: int) -> np.ndarray:
        """Vectors found with a cosine of at least ``least``: the beam widens while its worst is still above."""
        start = self.climb_down(query, 0)
        while width <= WIDEST and width < len(self.vectors):
            best = self.beam(query, start, width)
            if best[0][0] < least or len(best) < width:
                return np.array([x for s, x in best if s >= least], np.int64)
            width *= 4
        return np.flatnonzero(self.vectors @ query >= least)


def unit(embeddings: pd.Series) -> np.ndarray:
    held = np.stack(embeddings.to_list()).astype(np.float64)
    held /= np.abs(held).max(1)[:, None]
    return held / np.linalg.norm(held, axis=1)[:, None]


def audited(graph: Graph, nodes: np.ndarray, ids: np.ndarray, queries: np.ndarray, least: float) -> tuple[int, float]:
    """The beam width at which queries find RECALL of their links to others, and the share found; beyond WIDEST the whole shard is compared."""
    at = np.random.default_rng(1).permutation(len(ids))[:LOOKED]
    linked = (queries[at] @ graph.vectors.T >= least) & (ids[at, None] != nodes)
    some = np.flatnonzero(linked.any(1))[:AUDIT]
    total, width, share = int(linked[some].sum()), NARROWEST, 1.0
    while total and width <= WIDEST:
        share = sum(int(linked[i, graph.above(queries[at[i]], least, width)].sum()) for i in some) / total
        if share >= RECALL:
            break
        width *= 2
    return width, share if width <= WIDEST else 1.0


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable), kept (vec_id = component_id) of every row.

    Only vectors of one label that is not null and one dimension compare. Null, zero or empty vectors and
    those with null or non-finite components link with nothing. Equal vectors of a label meet once, with their
    number. Rows without vec_id take no part; of a repeated vec_id each row counts as a link of the others.
    Other columns are left out. An empty table stays empty.
    """
    rows = vectors.where("vec_id is not null").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    classes = written(rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "vectors")
    shards = classes.groupBy("label", F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    shards = written(shards, "shards")
    sizes = shards.agg(F.sum(F.col("shards") * F.col("parts")).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    groups = sizes["groups"] or 1
    dealt = classes.withColumn("dims", F.size("embedding")).join(shards.drop("n"), ["label", "dims"])
    shard = F.pmod(F.xxhash64("node", F.lit(1)), F.col("shards")).cast("int")

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        exact = unit(group["embedding"])
        held = pickle.dumps((group["node"].to_numpy(), group["n"].to_numpy(), exact, Graph(exact.astype(np.float32))))
        return pd.DataFrame({"label": [key[0]], "dims": [key[1]], "shard": [key[2]], "parts": [int(group["parts"].iloc[0])], "graph": [held]})

    tasks = tasks_for(groups, sizes["n"])
    graphs = dealt.withColumn("shard", shard).repartition(tasks, "label", "dims", "shard").groupBy("label", "dims", "shard").applyInPandas(make, "label string, dims int, shard int, parts int, graph binary")
    graphs = written(graphs, "graphs").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))

    def meet(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = {"node": [], "links": [], "to": []}
        if len(index) and len(wanted):
            nodes, sizes, exact, graph = pickle.loads(index["graph"].iloc[0])
            ids, queries = wanted["node"].to_numpy(), unit(wanted["embedding"])
            width, _ = audited(graph, nodes, ids, queries.astype(np.float32), least - 1e-5)
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            for i, q in zip(ids.tolist(), queries, strict=True):
                found = graph.above(q.astype(np.float32), least - 1e-5, width)
                found = found[nodes[found] != i]
                found = found[exact[found] @ q >= least]
                out["node"].append(i)
                out["links"].append(int(sizes[found].sum()))
                for x in nodes[found].tolist():
                    a, b = top(i), top(x)
                    if a != b:
                        root[max(a, b)] = min(a, b)
            out["to"] = [top(i) for i in out["node"]]
            others = [x for x in root if x not in set(out["node"])]
            out["node"] += others
            out["links"] += [0] * len(others)
            out["to"] += [top(x) for x in others]
        return pd.DataFrame(out).astype("int64")

    keys = ["label", "dims", "shard", "part"]
    graphs, asked = graphs.repartition(tasks, *keys), asked.repartition(tasks, *keys)
    met = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "node long, links long, to long")
    met = written(met, "met")
    found = components(met.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    of = classes.join(links, "node", "left").join(found, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    linked = rows.where(good).join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e, embedding is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good
  from embeddings
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.good and b.good and list_cosine_similarity(a.e, b.e) >= 0.98
), r as (
  select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a
), c as (
  select a, min(b) as component_id from r group by a
), n as (
  select a, count(*) as n from l group by a
)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.a = v.vec_id left join n on n.a = v.vec_id
"""
