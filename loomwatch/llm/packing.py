"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents become token ids with a closing id and are cut into full pieces and a rest. Only the histogram of
piece lengths (as many rows as a sequence has tokens) reaches the driver, where lengths are placed longest
first, each into the open packing pattern with most room; patterns carry counts, so the work depends on the
sequence size, not on the number of documents. What room then remains is filled by cutting pieces of the
least filled patterns. The patterns go back to the documents by the rank of each piece among those of its
length.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import buckets_for, ranked, table, written

#: Slots that are broadcast at most (about 60 bytes each).
BROADCAST_SLOTS = 400_000
# Fixed values of byte-level vocabularies: what merges don't cross, and the characters that stand for bytes:
# printable ones for themselves, the others, in order, from U+0100.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class Encoder:
    """The tokenizer's ids of whole texts.

    A byte-level vocabulary of ranked merges can be given to a faster encoder of the same kind; its ids are
    those of the tokenizer for all text without the names of special tokens, which only the tokenizer knows.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.load = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))
        tokenizer = Tokenizer.from_file(path)  # not kept: few texts need it
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(BYTES[c] for c in t): i for t, i in tokenizer.get_vocab().items() if t not in self.special}
        self.encode = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.load().encode(text, add_special_tokens=False).ids
        return self.encode(text)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def token_pieces(documents: DataFrame, tokenizer: str, closing_id: int, size: int) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (binary, little-endian unsigned 32-bit) of pieces of at most size tokens."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows = batch.iloc[at : at + 500], []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = np.asarray([*encode(text or ""), closing_id], "<u4").tobytes()
                    n = len(ids) // 4
                    rows += [(doc_id, s, min(size, n - s), n, ids[4 * s : 4 * (s + size)]) for s in range(0, n, size)]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])

    docs = documents.where("doc_id is not null").select("doc_id", "text")
    return docs.mapInPandas(pieces, "doc_id long, start long, length int, doc_tokens long, ids binary")


def spread(items: list[tuple[int, int, int, int, int]], size: int) -> list[list]:
    """Packs, as [count, tokens, parts]. items: (tokens, count, length of the piece, first rank, start in the piece).

    Longest first; each goes to the patterns with the fewest tokens that have room, or opens a pattern.
    """
    room: dict[int, list[list]] = {}
    for tokens, count, *part in sorted(items, reverse=True):
        while count:
            most = max(room, default=0)
            if most < tokens:
                room.setdefault(size - tokens, []).append([count, tokens, [(*part, tokens)]])
                break
            pack = room[most].pop()
            used = min(pack[0], count)
            if pack[0] > used:
                room[most].append(rest(pack, used))
            if not room[most]:
                del room[most]
            room.setdefault(most - tokens, []).append([used, pack[1] + tokens, [*pack[2], (*part, tokens)]])
            part[1] += used
            count -= used
    return [p for ps in room.values() for p in ps]


def rest(pack: list, used: int) -> list:
    """What is left of the packs when the first ``used`` go elsewhere; ranks go on."""
    return [pack[0] - used, pack[1], [(length, rank + used, start, n) for length, rank, start, n in pack[2]]]


def fill_gaps(packs: list[list], size: int, least: int) -> list[list]:
    """Fills room of at least ``least`` tokens by cutting up the least filled packs. A power of two needs no padding."""
    gap = lambda p: 0 if p[1] & (p[1] - 1) == 0 else size - p[1]
    done = [p for p in packs if gap(p) < least]
    todo = deque(sorted((p for p in packs if gap(p) >= least), key=lambda p: -p[1]))
    loose: deque = deque()  # (tokens, count, length, rank, start)
    need = sum(gap(p) * p[0] for p in todo)
    while todo:
        pack = todo.popleft()
        if not loose:
            giver = todo.pop() if todo else pack
            given = min(giver[0], -(-need // size))
            if giver is pack and given == pack[0]:
                done.append(pack)
                continue
            need -= gap(giver) * given
            loose.extend((n, given, length, rank, start) for length, rank, start, n in giver[2])
            if giver[0] > given:
                todo.append(rest(giver, given))
            if giver is not pack:
                todo.appendleft(pack)
            continue
        tokens, count, length, rank, start = loose.popleft()
        used, take = min(pack[0], count), min(size - pack[1], tokens)
        if pack[0] > used:
            todo.appendleft(rest(pack, used))
        if count > used:
            loose.appendleft((tokens, count - used, length, rank + used, start))
        if tokens > take:
            loose.appendleft((tokens - take, used, length, rank, start + take))
        need -= gap(pack) * used
        pack = [used, pack[1] + take, [*pack[2], (length, rank, start, take)]]
        if pack[1] == size:
            done.append(pack)
        else:
            need += gap(pack) * used
            todo.appendleft(pack)
    return done + spread(list(loose), size)


def plan(histogram: dict[int, int], size: int, least_gap: int) -> list[tuple]:
    """Slots: (length, first rank, end rank, start in the piece, tokens, sequence of the first rank, offset there)."""
    slots, sequence = [], 0
    packs = fill_gaps(spread([(n, count, n, 0, 0) for n, count in histogram.items()], size), size, least_gap)
    for count, _, parts in packs:
        offset = 0
        for length, rank, start, tokens in parts:
            slots.append((length, rank, rank + count, start, tokens, sequence, offset))
            offset += tokens
        sequence += count
    return slots


def pack(documents: DataFrame, tokenizer: str, closing_id: int = 1, size: int = 2048, least_gap: int = 8) -> DataFrame:
    """Pieces with their place: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    A null or empty text has the closing id only. Rows without doc_id take no part; repeated rows are packed
    each on their own. An empty table gives no pieces. Other columns are left out.
    """
    spark = documents.sparkSession
    pieces = written(token_pieces(documents, tokenizer, closing_id, size).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # size rows at most
    slots = plan(histogram, size, least_gap)
    held = spark.createDataFrame(slots or [], "s_length int, s_rank long, s_end long, s_start int, s_tokens int, s_sequence long, s_offset int")
    if len(slots) <= BROADCAST_SLOTS:
        held = F.broadcast(held)
    ranks = ranked(pieces.select("piece", "length"), ["length"], ["piece"], buckets_for(sum(histogram.values())))
    placed = ranks.join(held, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank")) & (F.col("rank") < F.col("s_end"))).select(
        F.col("piece").alias("p"), "s_start", "s_tokens", (F.col("s_sequence") + F.col("rank") - F.col("s_rank")).alias("sequence_id"), F.col("s_offset").cast("long").alias("offset")
    )
    return pieces.join(placed, F.col("piece") == F.col("p")).select(
        "doc_id",
        (F.col("start") + F.col("s_start")).alias("start"),
        F.col("s_tokens").cast("long").alias("length"),
        "doc_tokens",
        F.substring(F.col("ids"), F.col("s_start") * 4 + 1, F.col("s_tokens") * 4).alias("ids"),
        "sequence_id",
        "offset",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
