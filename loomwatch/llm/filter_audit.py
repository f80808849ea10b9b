"""How document filters interact: what each removes, shares with others and costs, in every order of application.

The last filter asks whether a smaller doc_id has the same text. Texts go to tasks by ranges of adaptive
prefixes, long enough that no prefix holds much more than a task's share, and are inserted whole into
compressed tries whose terminals hold the smallest id; a second walk over the rows gives the flags. Before they
are sent, each batch is put into a trie of its own: only the row with a text's smallest id there is open, all
others are known copies, so a text that a third of all rows share is sent once a batch. What is left of a row
is a mask of five bits, and counts by part and mask answer for all 120 orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import table, written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Code points of a prefix: where one holds too many bytes, its texts are told apart by the next.
LEVELS = (16, 64, 256, 1024, 4096, 16384, 65536)
#: Bytes of text that a task's tries hold.
TASK_BYTES = 16 << 20
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"


class Trie:
    """A compressed trie of byte strings; ``least`` is the smallest id of the text that ends here."""

    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes = b""):
        self.label, self.children, self.least = label, None, None

    def insert(self, text: bytes, of: int) -> Trie:
        """The terminal of the text, with of counted in."""
        node, at = self, 0
        while at < len(text):
            child = node.children and node.children.get(text[at])
            if not child:
                child = Trie(text[at:])
                node.children = node.children or {}
                node.children[text[at]] = child
            elif not text.startswith(child.label, at):
                child = node.split(child, text, at)
            node, at = child, at + len(child.label)
        if node.least is None or of < node.least:
            node.least = of
        return node

    def split(self, child: Trie, text: bytes, at: int) -> Trie:
        """A node between this one and child, up to where child's label and the text part; they share a byte at least."""
        low, high = 1, min(len(child.label), len(text) - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if text.startswith(child.label[:mid], at) else (low, mid - 1)
        between = Trie(child.label[:low])
        child.label = child.label[low:]
        between.children = {child.label[0]: child}
        self.children[between.label[0]] = between
        return between


def failing(text: str, data: bytes) -> int:
    """The bits of the filters that look at the text alone."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * capitals > 5 * len(text)) << 2
        | (len(data.translate(None, SIGNS)) < len(data)) << 3
    )


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask, n, text of the documents' rows; text is null where it is known whether the row is a copy, n counts equal rows of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trie, rows = Trie(), []
            for of, part, text in zip(batch["doc_id"].astype(object), batch["part"], batch["text"], strict=True):
                data = text.encode()
                rows.append((None if pd.isna(of) else int(of), part, failing(text, data), None if pd.isna(of) else trie.insert(data, int(of)), text))
            found: dict[tuple, int] = {}
            for of, part, mask, node, text in rows:
                open_ = node is not None and of == node.least
                key = (of, part, mask if open_ or node is None else mask | COPY, text if open_ else None)
                found[key] = found.get(key, 0) + 1
            yield pd.DataFrame([(of, part, mask, n, text) for (of, part, mask, text), n in found.items()], columns=["doc_id", "part", "mask", "n", "text"]).astype({"doc_id": "Int64"})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(run, "doc_id long, part string, mask int, n long, text string")


def keyed(rows: DataFrame, limit: int) -> DataFrame:
    """Adds key, the shortest prefix by LEVELS that rows of at most ``limit`` bytes share, by counts over all rows.

    The prefixes that more share are at most all bytes over the limit a level, so they are broadcast.
    """
    prefix = lambda p: F.xxhash64(F.lit(p), F.substring("text", 1, p))
    ends = F.array(*[F.when(F.length("text") > p, F.struct(F.lit(p).alias("level"), prefix(p).alias("h"))) for p in LEVELS[:-1]])
    counted = rows.select(F.octet_length("text").alias("bytes"), F.explode(F.array_compact(ends)).alias("e")).groupBy("e.level", "e.h").agg(F.sum("bytes").alias("bytes"))
    heavy = written(counted.where(F.col("bytes") > limit).select("level", "h"), "heavy-prefixes")
    out = rows.withColumn("depth", F.lit(LEVELS[0]))
    for (p,) in sorted(heavy.select("level").distinct().collect()):
        hit = heavy.where(F.col("level") == p).select(F.col("h").alias("__h"))
        out = out.withColumn("__p", prefix(p)).join(F.broadcast(hit), F.col("__p") == F.col("__h"), "left")
        out = out.withColumn("depth", F.when(F.col("__h").isNotNull(), LEVELS[LEVELS.index(p) + 1]).otherwise(F.col("depth"))).drop("__p", "__h")
    return out.withColumn("key", F.substring("text", F.lit(1), F.col("depth"))).drop("depth")


def with_copies(rows: DataFrame) -> DataFrame:
    """doc_id, part, mask, n of the open rows, by tries over ranges of their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, parts = Trie(), []
        for batch in batches:
            nodes = [trie.insert(t.encode(), i) for t, i in zip(batch["text"], batch["doc_id"], strict=True)]
            parts.append((batch.drop(columns="text"), nodes))
        for batch, nodes in parts:
            copy = batch["doc_id"].to_numpy() > [n.least for n in nodes]
            yield batch.assign(mask=batch["mask"] | copy * COPY)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    dealt = keyed(rows, max(1, size // (4 * tasks))).repartitionByRange(tasks, "key").drop("key")
    return dealt.mapInPandas(run, "doc_id long, part string, mask int, n long")


def masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: how many rows of a document and part fail which filters (bits in the order of FILTERS)."""
    rows = written(scanned(documents), "scanned-texts").select("doc_id", "part", "mask", "n", "text")
    copies = with_copies(rows.where("text is not null"))
    return written(copies.unionByName(rows.where("text is null").drop("text")).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")), "masks")


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the filter's bit, the bits of the filters before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(o), k + 1, bit[o[k]], sum(bit[f] for f in o[:k])) for o in permutations(FILTERS) for k in range(len(o))]


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 50 words; B fewer than 65 distinct of 100 words; C over 5 capitals of 100 code points; D holds
    any of #$%&*|; E a smaller doc_id has the same text. A null text is empty, a null source the empty one. Repeated
    rows count each, and those with equal ids are no copies of one another; rows without doc_id are no copies, have
    none and have no label. A document is good or toxic if any row of labels says so; nulls there say nothing.
    Other columns are not read. An empty table gives no rows.
    """
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__of")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c) for c in ("quality", "toxic")]
    )
    rows = masks(documents).join(of, F.col("doc_id") == F.col("__of"), "left")
    weight = {"n": F.col("n"), "good": F.col("n") * F.coalesce("quality", F.lit(0)), "toxic": F.col("n") * F.coalesce("toxic", F.lit(0))}
    counts = rows.groupBy("part", "mask").agg(*[F.sum(w).alias(c) for c, w in weight.items()])
    each = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, k, b, p in steps()])
    wide = counts.select("part", "mask", "n", "good", "toxic", F.explode(each).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, what, name: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).alias(name)
    first = F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1)) * F.col("n")  # in so many orders the filter comes first of those that fail
    return wide.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"), total(fails & ~gone, "good", "good_lost"), total(fails & ~gone, "toxic", "toxic_lost"),
        F.coalesce(F.sum(F.when(fails, first.cast("long"))), F.lit(0)).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), f as (
  select doc_id, part, (len(words) < 50)::int as a, (100 * len(list_distinct(words)) < 65 * len(words))::int as b,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::int as c,
    regexp_matches(text, '[#$%&*|]')::int as d, coalesce(doc_id > min(doc_id) over (partition by text), false)::int as e from w
), l as (
  select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic from labels group by 1
), m as (
  select part, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from f left join l using (doc_id) group by all
), x(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o as (
  select p.f || q.f || r.f || s.f || t.f as filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] as bits from x p, x q, x r, x s, x t
  where p.bit + q.bit + r.bit + s.bit + t.bit = 31 and len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5
), s as (
  select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1:k-1]), 0)::int as before from o, range(1, 6) g(k)
)
select part, filter_order, step::int as step,
  coalesce(sum(n) filter (mask & (before + bit) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) filter (mask & bit <> 0), 0)::bigint as shapley
from m, s group by part, filter_order, step
"""
