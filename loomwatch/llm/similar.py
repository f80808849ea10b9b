"""Near-duplicates by the similarity of their five-word shingles: SimHash finds candidates, the shingles decide.

Documents meet under keys made of minima of their shingles' hashes, so whether a pair meets depends on its
similarity alone and not on the number of rows. Those that meet are compared bit-sliced by their SimHash
fingerprints, and what lies within the radius is a candidate. Each candidate's shingles are then compared
themselves. First every document is held against the one that most of its group lie near; after that every
candidate pair whose documents are still apart, in the task where they meet, so that no list of pairs leaves
it. A large group of near copies takes about as many comparisons as it has documents, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm import simhash
from loomwatch.llm.common import few, join_counted, written
from loomwatch.llm.components import components
from loomwatch.llm.simhash import bits_of, further, near

#: Words of a shingle, words of 64 bits of a fingerprint.
SHINGLE, WORDS = 5, 4
#: Keys and minima of a key: a pair at similarity 0.8 shares none with a chance of (1 - 0.8 ** 5) ** 24 = 0.00007.
KEYS, MINIMA = 24, 5
#: Of 256 bits a pair at similarity 0.8 changes 40, give or take 6; very short texts up to 48.
RADIUS = 72
#: Texts of a part when pairs are verified: a task holds the hashes of twice as many.
TILE = 512
RNG = np.random.default_rng(7)
FACTORS = RNG.integers(0, 1 << 63, (KEYS * MINIMA, 1), np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = RNG.integers(0, 1 << 63, (KEYS * MINIMA, 1), np.uint64)


def shingles(text: str | None) -> set[bytes]:
    tokens = (text or "").encode().lower().split()
    k = min(SHINGLE, len(tokens))
    return {b" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)} if tokens else set()


def hashed(text: str | None) -> np.ndarray:
    """The hashes of the set of shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether common shingles are at least 0.8 of all, by their hashes."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def signature(text: str | None) -> tuple[bytes, bytes, np.ndarray]:
    """A digest of the set of shingles, its fingerprint and its keys (none without words)."""
    hashes = hashed(text)
    out = []
    for word in range(WORDS):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
            votes += np.unpackbits(further(hashes[at : at + 255], word).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint8)
        out.append(np.packbits(2 * votes > len(hashes)).tobytes())
    least = np.full(KEYS * MINIMA, simhash.ALL)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (FACTORS * hashes[at : at + 1024] + OFFSETS).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(k.tobytes(), i) for i, k in enumerate(least.reshape(KEYS, MINIMA))] if len(hashes) else []
    return xxhash.xxh3_128_digest(hashes.tobytes()), b"".join(out), np.array(keys, np.uint64).view(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signature(t) for t in batch["text"]]
            yield pd.DataFrame({"row": batch["row"], "same": [x[0] for x in found], "print": [x[1] for x in found], "keys": [x[2] for x in found]})

    return documents.select("row", "text").mapInPandas(run, "row long, same binary, print binary, keys array<long>")


def stars(bits: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row that has any other within the radius one pair, with the row that most of a block lie near."""
    size = simhash.BLOCK
    most, hub = np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)

    def noted(found: np.ndarray, row: int, column: int) -> None:
        weights = found * (found.sum(0) + 1)[None, :]
        best = weights.argmax(1)
        weight, rows = weights[np.arange(len(best)), best], row + np.arange(len(best))
        better = weight > most[rows]
        most[rows[better]], hub[rows[better]] = weight[better], column + best[better]

    for i in range(0, len(bits), size):
        for j in range(i, len(bits), size):
            found = near(bits[i : i + size], bits[j : j + size], RADIUS)
            found &= ids[i : i + size, None] != ids[None, j : j + size]
            if found.any():
                noted(found, i, j)
                if j > i:
                    noted(found.T, j, i)
    a, b = ids[most > 0], ids[hub[most > 0]]
    return np.minimum(a, b), np.maximum(a, b)


def tile_links(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links of labels, at most one fewer than there are, that connect what is similar within the groups of the tile.

    A pair counts in the group of the first key that its rows share. Rows that a link connects are not compared again.
    """
    group, at, part, labels = (rows[c].to_numpy() for c in ("group", "at", "part", "label"))
    bits, keys = bits_of(rows["print"].to_list()), np.stack(rows["keys"].to_list())
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    sizes = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, links = np.zeros(len(names), bool), labels.copy(), []
    found = near(bits, bits, RADIUS) & (group[:, None] == group[None, :])
    found &= rows["alone"].to_numpy()[:, None] | (part[:, None] != part[None, :])
    for i in np.flatnonzero(np.triu(found, 1).any(1)):
        others = i + 1 + np.flatnonzero(found[i, i + 1 :] & (label[i + 1 :] != label[i]))
        others = others[~(keys[others, : at[i]] == keys[i, : at[i]]).any(1)]
        if not len(others):
            continue
        low, own = others[0], codes[starts[i] : starts[i + 1]]
        mark[own] = True
        held = mark[codes[starts[low] : starts[others[-1] + 1]]]
        mark[own] = False
        common = np.add.reduceat(held, starts[low : others[-1] + 1] - starts[low], dtype=np.int64)[others - low]
        joined = np.unique(label[others[5 * common >= 4 * (sizes[i] + sizes[others] - common)]])
        if len(joined):
            links += [(int(label[i]), int(x)) for x in joined]
            label[np.isin(label, joined)] = label[i]
    return links


def cuts(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """The rows, which come sorted by group, in cuts of whole groups: small ones share a block, groups of one row are left out."""

    def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        group = rows["group"].to_numpy()
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(group)])
        at, few = 0, block // 4
        some = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= few), sizes))
        while at < len(some):
            end = min(at + block, len(some))
            while end < len(some) and group[some[end]] == group[some[end - 1]]:  # not within a group
                end -= 1
            yield rows.iloc[some[at:end]]
            at = end
        for a, n in zip(first, sizes, strict=True):
            if n > few:
                yield rows.iloc[a : a + n]

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        cut = int((held["group"].to_numpy() != held["group"].iloc[-1]).sum())  # the last group may go on
        if cut:
            yield from whole(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield from whole(held)


def meetings(nodes: DataFrame, columns: list[str], most: int, wide: tuple[str, ...] = ()) -> DataFrame:
    """group, at (the key's place), part, alone (both parts are one) and the columns: each node once for each key that nodes of several labels share.

    Wide columns come to the nodes that meet, so that they don't go with every key.

    A key that more than ``most`` nodes share is dealt out in pairs of parts, so that every pair still meets.
    """
    keyed = nodes.select("label", *columns, F.posexplode("keys").alias("at", "key")).withColumn("group", F.xxhash64("at", "key")).drop("key")
    shared = keyed.groupBy("group").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    parts = F.when(F.col("n") > most, F.ceil(F.col("n") / (most // 2))).otherwise(1).cast("int")
    shared = written(shared.select("group", parts.alias("parts")), "shared-keys")
    met = keyed.join(few(shared), "group").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other"))
    met = met.select(group.alias("group"), "at", "part", (F.col("part") == F.col("other")).alias("alone"), "label", *columns)
    return met.join(nodes.select("node", *wide), "node") if wide else met


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes (node, print, keys, label) that share a key and lie within the radius: at most one a node and group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cut in cuts(batches, simhash.BLOCK):  # a pair found between groups is a candidate too
            a, b = stars(bits_of(cut["print"].to_list()), cut["node"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    met = meetings(nodes, ["node", "print"], simhash.HOT).select("group", "node", "print")
    found = met.repartition("group").sortWithinPartitions("group").mapInPandas(run, "a long, b long")
    return written(found.distinct(), "candidates")


def links_between(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) of labels that connect the labels of all similar nodes (node, print, keys, label) that share a key.

    The hashes of the shingles go to where the nodes meet, so pairs are verified there and only links leave the task.
    """
    met = written(meetings(nodes, ["node", "print"], 2 * TILE, ("keys",)), "meetings")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["row"], "hashes": [hashed(t).tobytes() for t in batch["text"]]})

    ends = written(met.select(F.col("node").alias("row")).distinct(), "meeting-ends")
    texts = documents.select("row", "text").join(few(ends), "row", "left_semi")
    sets = written(texts.mapInPandas(read, "node long, hashes binary"), "shingle-hashes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cut in cuts(batches, 128):
            yield pd.DataFrame(tile_links(cut), columns=["a", "b"], dtype=np.int64)

    tasks = max(24, met.count() // 20_000)  # few bytes but much work
    found = met.join(sets, "node").repartition(tasks, "group").sortWithinPartitions("group").mapInPandas(run, "a long, b long")
    return written(found, "label-links")


def verified(found: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs whose texts are similar.

    Texts are dealt to parts of about TILE, and the pairs of two parts are a tile, to which each of its texts
    comes once: pairs that lie densely do not each bring two texts along. A tile holds its texts' hashes.
    """
    ends = written(found.select(F.col("a").alias("row")).union(found.select(F.col("b").alias("row"))).distinct(), "ends")
    texts = written(documents.select("row", "text").join(few(ends), "row", "left_semi"), "candidate-texts")
    parts = F.lit(max(1, -(-ends.count() // TILE)))
    of_a, of_b = F.pmod(F.xxhash64("a", F.lit(5)), parts), F.pmod(F.xxhash64("b", F.lit(5)), parts)
    dealt = found.select(F.least(of_a, of_b).alias("p"), F.greatest(of_a, of_b).alias("q"), "a", "b")
    holds = dealt.select("p", "q", F.col("a").alias("row")).union(dealt.select("p", "q", F.col("b").alias("row"))).distinct()
    rows = holds.join(texts, "row").select("p", "q", F.col("row").alias("a"), F.col("row").alias("b"), F.lit(False).alias("pair"), "text")
    rows = rows.union(dealt.select("p", "q", "a", "b", F.lit(True), F.lit(None).cast("string")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tile, its texts before its pairs."""
        held, tile = {}, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (p, q, a, b, pair, text) in enumerate(batch.itertuples(index=False)):
                if (p, q) != tile:
                    held, tile = {}, (p, q)
                if pair:
                    keep[i] = similar(held[a], held[b])
                else:
                    held[a] = hashed(text)
            yield batch.loc[keep, ["a", "b"]]

    tasks = max(24, found.count() // 100_000)  # few bytes but much work
    return written(rows.repartition(tasks, "p", "q").sortWithinPartitions("p", "q", "pair").mapInPandas(run, "a long, b long"), "verified")


def groups(documents: DataFrame) -> DataFrame:
    """row, component (the smallest row reachable over similar pairs) of every document (row, text); rows are unique.

    Texts of the same shingles are one node, null, empty and blank ones among them. An empty table stays empty.
    """
    signed = written(signatures(documents), "signatures")
    nodes = written(signed.groupBy("same").agg(F.min("row").alias("node"), F.min("print").alias("print"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "nodes")
    links = verified(candidates(nodes.withColumn("label", F.col("node"))), documents)
    found = written(components(links), "components")
    apart = nodes.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    more = links_between(written(apart, "labelled"), documents)
    if not more.isEmpty():
        found = written(components(links.union(more)), "components")
    of = nodes.join(found, "node", "left").select("same", F.coalesce("component", "node").alias("component"), "copies")
    return written(join_counted(signed.select("row", "same"), written(of, "of-nodes"), ["same"], "copies").select("row", "component"), "groups")
