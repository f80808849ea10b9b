"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that may be near meet under keys made of some of their bits: all choices of blocks that must
agree within a small radius (exact), or enough random choices of bits for a wide one. Those that meet are
compared bit-sliced: the bit planes lie vertically, 64 fingerprints to a word, and one pass over the planes
updates all distances at once in carry-save counters; a block is abandoned once every distance exceeds the
radius. Only one link per fingerprint and comparison leaves the task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import table, written
from loomwatch.llm.components import components

#: Fingerprints compared at once, and those of one key beyond which the key is dealt out in pairs of parts.
BLOCK, HOT = 512, 20_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def further(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits of each hash; word 0 is the hash itself."""
    if not word:
        return hashes
    h = (hashes + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def fingerprint(text: str | None, shingle: int = 3, words: int = 1, seed: int = 42) -> bytes:
    """words x 64 bits (big-endian), each set where more than half of the shingles' hashes have it; 0 without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six white-space characters only
    if not tokens:
        return bytes(8 * words)
    joined, n = b" ".join(tokens), len(tokens)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum([len(w) + 1 for w in tokens], out=starts[1:])
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), (starts[k:] - 1).tolist(), strict=True)], np.uint64)
    out = []
    for word in range(words):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
            votes += np.unpackbits(further(hashes[at : at + 255], word).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint8)
        out.append(np.packbits(2 * votes > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(documents: DataFrame, shingle: int, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "print": [fingerprint(t, shingle, words) for t in batch["text"]]})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, print binary")


def bits_of(prints: list[bytes]) -> np.ndarray:
    """A row of bits for each fingerprint."""
    return np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of a lie within radius of which of b (rows of bits), by carry-save counters that start so that radius + 1 overflows."""
    width = -(-len(b) // 64)
    padded = np.zeros((b.shape[1], width * 64), np.uint8)
    padded[:, : len(b)] = b.T
    vertical = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    own = np.where(a.T.astype(bool), ALL, np.uint64(0))
    k = int(radius).bit_length()
    start = (1 << k) - 1 - radius
    counters = [np.full((len(a), width), ALL if start >> i & 1 else np.uint64(0)) for i in range(k)]
    over = np.zeros((len(a), width), np.uint64)
    for p in range(len(vertical)):
        carry = vertical[p] ^ own[p][:, None]
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if p % 16 == 15 and over.all() and (over == ALL).all():
            return np.zeros((len(a), len(b)), bool)
    return np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(b)].astype(bool)


def group_links(bits: np.ndarray, ids: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is near within the group: for each pair of blocks at most one a fingerprint."""
    most = np.iinfo(np.int64).max
    for i in range(0, len(bits), BLOCK):
        for j in range(i, len(bits), BLOCK):
            found = near(bits[i : i + BLOCK], bits[j : j + BLOCK], radius)
            if j == i:
                np.fill_diagonal(found, False)
            left_at, right_at = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
            if not len(left_at):
                continue
            found = found[np.ix_(left_at, right_at)]
            left, right = ids[i + left_at].copy(), ids[j + right_at].copy()
            while True:  # labels go along the links until they rest
                old = left.copy(), right.copy()
                np.minimum(left, np.where(found, right[None, :], most).min(1), out=left)
                np.minimum(right, np.where(found, left[:, None], most).min(0), out=right)
                if (old[0] == left).all() and (old[1] == right).all():
                    break
            a, b = np.r_[ids[i + left_at], ids[j + right_at]], np.r_[left, right]
            yield a[a != b], b[a != b]


def block_choices(size: int, radius: int, blocks: int) -> list[np.ndarray]:
    """Bits of each choice of blocks - radius blocks: fingerprints within the radius agree in one of them."""
    cut = np.array_split(np.arange(size), blocks)
    return [np.concatenate([cut[i] for i in c]) for c in combinations(range(blocks), blocks - radius)]


def random_choices(size: int, radius: int, rows: int, miss: float = 0.02, seed: int = 8) -> list[np.ndarray]:
    """So many random choices of bits that a pair at four fifths of the radius misses them all with that chance.

    A choice has fewer bits than a key of each row needs by 7, so about a hundred fingerprints share a key.
    """
    width = max(8, int(rows).bit_length() - 7)
    hit = (1 - 0.8 * radius / size) ** width
    rng = np.random.default_rng(seed)
    return [rng.choice(size, width, replace=False) for _ in range(math.ceil(math.log(miss) / math.log(1 - hit)))]


def near_links(nodes: DataFrame, radius: int, choices: list[np.ndarray]) -> DataFrame:
    """Links (a, b) that connect the nodes (node, print) found within the radius, prints being distinct.

    A key that more than HOT fingerprints share is dealt out: they fall in parts, and each pair of parts
    meets in a group of its own, so that every pair is still compared and no group grows without bound.
    """

    def make_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                bits = bits_of(part["print"].to_list())
                for i, choice in enumerate(choices):
                    held = np.packbits(bits[:, choice], axis=1)
                    keys = [xxhash.xxh64_intdigest(k.tobytes(), i) for k in held]
                    yield pd.DataFrame({"group": np.array(keys, np.uint64).view(np.int64), "print": part["print"].to_numpy(), "node": part["node"].to_numpy()})

    keyed = nodes.select("node", "print").mapInPandas(make_keys, "group long, print binary, node long")
    counts = nodes.select("node", "print").mapInPandas(make_keys, "group long, print binary, node long").groupBy("group").count()
    hot = written(counts.where(F.col("count") > HOT).select("group", F.ceil(F.col("count") / (HOT // 2)).cast("int").alias("parts")), "hot-keys")
    if not hot.isEmpty():
        part = F.pmod(F.xxhash64("print", F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int")
        keyed = keyed.join(hot, "group", "left").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        keyed = keyed.withColumn("group", F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; small groups share a block, for a link found between groups is a link too."""

        def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for a, b in group_links(bits_of(rows["print"].to_list()), rows["node"].to_numpy(), radius):
                yield pd.DataFrame({"a": a, "b": b})

        def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            group = rows["group"].to_numpy()
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[first, len(group)])
            at, some = 0, np.flatnonzero(np.repeat((sizes > 1) & (sizes <= BLOCK // 4), sizes))
            while at < len(some):
                end = min(at + BLOCK, len(some))
                while end < len(some) and group[some[end]] == group[some[end - 1]]:  # not within a group
                    end -= 1
                yield from links(rows.iloc[some[at:end]])
                at = end
            for a, n in zip(first, sizes, strict=True):
                if n > BLOCK // 4:
                    yield from links(rows.iloc[a : a + n])

        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cut = int((held["group"].to_numpy() != held["group"].iloc[-1]).sum())  # the last group may go on
            if cut:
                yield from whole(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield from whole(held)

    return keyed.select("group", "print", "node").repartition("group").sortWithinPartitions("group").mapInPandas(run, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = 3, shingle: int = 3, words: int = 1, blocks: int | None = 5) -> DataFrame:
    """doc_id, print (big-endian) and component_id (the smallest doc_id reachable over links) of every document.

    With blocks every link is found; without, random choices of bits find those well within the radius with
    98 % or more. Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows come
    out as often as they come in. Rows without doc_id take no part. Other columns are left out. An empty
    table stays empty.
    """
    prints = written(fingerprints(documents, shingle, words), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("node")), "print-nodes")
    size = 64 * words
    choices = block_choices(size, radius, blocks) if blocks else random_choices(size, radius, nodes.count())
    found = components(near_links(nodes, radius, choices))
    classes = written(nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")), "print-classes")
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")
