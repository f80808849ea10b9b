"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes.

A single edit of a word leaves all of it but one segment as it was. So each word is keyed, for its own length and
for the next, by what is left without each of three segments, and words that are near share a key. The words of
a key are laid into padded matrices of code points, and blocks of rows are compared pair by pair: two words
are near if their common prefix and common suffix together reach the longer length minus one. A key shared by
more than a block is dealt in pairs of parts. How many words can share a key is bounded by the letters of a
segment and not by the corpus, as is the number of words near one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import ascii_lower, table, written

LETTERS = r"A-Za-zÀ-ÿ"
#: Segments of a word.
SEGMENTS = 3
#: Rows of a block; words of a key from which on it is dealt in parts.
BLOCK, HOT = 128, 4096
#: Keyed words of a task.
TASK_ROWS = 100_000


def runs(documents: DataFrame, least: int) -> DataFrame:
    """word: the runs of letters of whole texts, with the contract's deletions; only those that can reach the least length."""
    found = documents.select(F.col("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    found = found.select(ascii_lower(F.col("run")).alias("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("of"))
    h, size = F.crc32(F.concat_ws(":", "of", "run").cast("binary")), F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), F.col("p")), F.substring("run", F.col("p") + 2, size))
    return found.withColumns({"h": h, "p": F.pmod(h, size).cast("int")}).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def bounds(length: int | np.ndarray, s: int) -> int | np.ndarray:
    """Where segment s of a word begins; that of SEGMENTS is its end."""
    return length * s // SEGMENTS


def keyed(words: DataFrame) -> DataFrame:
    """word, n, m, s, key: for m the word's length and the next, its hash without segment s of m; empty segments have no key."""
    m, s = F.col("m"), F.col("s")
    begin, end = F.floor(m * s / SEGMENTS).cast("int"), F.floor(m * (s + 1) / SEGMENTS).cast("int")
    of = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    of = of.withColumns({"begin": begin, "left": m - end}).where(begin < end)
    rest = F.xxhash64("m", "s", F.substring("word", F.lit(1), F.col("begin")), F.expr("right(word, left)"))
    return of.select("word", "n", "m", "s", rest.alias("key"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of every row of a with every row of b; equal padding counts."""
    alive, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T, b.T, strict=True):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        out += alive
    return out


def matrices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with padding behind, and of the reversed words; lengths."""
    forward = words.view(np.uint32).reshape(len(words), -1)
    sizes = np.char.str_len(words)
    at = sizes[:, None] - 1 - np.arange(forward.shape[1])[None, :]
    return forward, np.where(at < 0, 0, np.take_along_axis(forward, np.maximum(at, 0), 1)), sizes


def tile(rows: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, best (-n and word of the first near one): per row of the tile that has any near in it.

    A pair counts under the length of its longer word and the first segment that it can differ in, so it counts once.
    """
    word, n = rows["word"].to_numpy().astype(str), rows["n"].to_numpy()
    m, s, key, part = (rows[c].to_numpy() for c in ("m", "s", "group", "part"))
    alone = rows["alone"].to_numpy()
    forward, backward, sizes = matrices(word)
    order = np.lexsort((word, -n))
    rank = np.empty(len(word), np.int64)
    rank[order] = np.arange(len(word))
    count, best = np.zeros(len(word), np.int64), np.full(len(word), len(word))
    for i in range(0, len(word), BLOCK):
        for j in range(i, len(word), BLOCK):
            x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
            if key[x][-1] < key[j]:  # sorted: no key reaches from one block to the other
                break
            shared = key[x][:, None] == key[y][None, :]
            if i == j:
                shared = np.triu(shared, 1)
            longer = np.maximum(sizes[x][:, None], sizes[y][None, :])
            shorter = np.minimum(sizes[x][:, None], sizes[y][None, :])
            prefix = np.minimum(near(forward[x], forward[y]), shorter)
            suffix = np.minimum(near(backward[x], backward[y]), shorter)
            a, b = np.nonzero(shared & (prefix + suffix >= longer - 1) & (longer == m[x][:, None]) & (m[x][:, None] == m[y][None, :]) & (s[x][:, None] == s[y][None, :]))
            prefix, suffix, a, b = prefix[a, b], suffix[a, b], a + i, b + j
            first = np.full(len(a), SEGMENTS)
            for t in range(SEGMENTS - 1, -1, -1):
                begin, end = bounds(m[a], t), bounds(m[a], t + 1)
                first[(prefix >= begin) & (suffix >= m[a] - end) & (begin < end)] = t
            keep = (first == s[a]) & (word[a] != word[b]) & (alone[a] | (part[a] != part[b]))
            a, b = a[keep], b[keep]
            for p, q in ((a, b), (b, a)):
                np.add.at(count, p, 1)
                np.minimum.at(best, p, rank[q])
    has = np.flatnonzero(count)
    of = order[best[has]]
    return pd.DataFrame({"word": word[has], "n_near": count[has], "form_n": n[of], "form": word[of]})


def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows, sorted by group, in cuts of whole groups: small ones share a block, groups of one row are left out."""

    def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        group = rows["group"].to_numpy()
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(group)])
        rows = rows[np.repeat(sizes > 1, sizes)]
        ends = np.cumsum(sizes[sizes > 1])
        at = 0
        while at < len(rows):
            fits = ends[ends <= at + BLOCK]
            end = int(fits[-1]) if len(fits) and fits[-1] > at else int(ends[ends > at][0])
            yield rows.iloc[at:end]
            at = end

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        cut = int(np.searchsorted(held["group"].to_numpy(), held["group"].iloc[-1]))  # the last group may go on
        if cut:
            yield from whole(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield from whole(held)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n for each of the distinct words (word, n) that has near ones: the near one of largest n, first in code-point order."""
    keys = keyed(words)
    hot = written(keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT), "hot-keys")
    parts = F.coalesce(F.ceil(F.col("rows") / (HOT // 2)), F.lit(1)).cast("int")
    dealt = keys.join(hot, "key", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word", F.lit(3)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    dealt = dealt.select("word", "n", "m", "s", group.alias("group"), "part", (F.col("part") == F.col("other")).alias("alone"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cut in cuts(batches):
            found = tile(cut)
            if len(found):
                yield found

    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * SEGMENTS * words.count() // TASK_ROWS)
    found = dealt.repartition(tasks, "group").sortWithinPartitions("group").mapInPandas(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead in the end. Each round follows twice as many; a form's n is a multiple of its word's, so rounds are few."""
    point = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = point.select(F.col("word").alias("root"), F.col("root").alias("onto"))
        after = written(point.join(onward, "root", "left").select("word", F.coalesce("onto", "root").alias("root"), F.col("onto").isNotNull().alias("moved")), "forms")
        point = after.select("word", "root")
        if after.where("moved").isEmpty():
            return point


def variants(documents: DataFrame, least: int = 7, times: int = 2, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least ``least`` code points that occurs ``times`` or more.

    Words are runs of letters with A-Z lower-cased; where 31 divides the crc32 of ``<doc_id>:<run>``, the code point
    at it modulo the length is deleted. form is the near word (one code point inserted, deleted or replaced) of
    largest n, ties to the first in code-point order, if that n is ``ratio`` times the word's or more; root is
    where forms lead. Null and empty texts have no words, a null doc_id counts as an empty one, repeated rows
    count each, other columns are not read. An empty table gives no rows.
    """
    counted = runs(documents, least).groupBy("word").agg(F.count("*").alias("n"))
    words = written(counted.where((F.col("n") >= times) & (F.length("word") >= least)), "words")
    beside = near_words(words)
    enough = F.col("form_n") >= ratio * F.col("n")
    full = words.join(beside, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")
    )
    full = written(full, "variants")
    found = roots(full.where("form is not null"))
    return full.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
with recursive poly(i, k, v) as (
  select i, 0, i::bigint from range(256) t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from poly where k < 8
), tab as materialized (
  select list(v order by i) as t from poly where k = 8
), r as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents
), l as materialized (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c from r where length(run) >= 7 group by all
), h as (
  select run, c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(regexp_replace(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h from l, tab
), w as (
  select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from h
), v as materialized (
  select word, sum(c)::bigint as n from w group by word having length(word) >= 7 and sum(c) >= 2
), d as materialized (
  select word, n, i, left(word, i) || substr(word, i + 2) as rest from v, unnest(range(length(word))) t(i)
), near as materialized (
  select distinct a.word, b.word as other, b.n as other_n from d a join d b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select d.word, v.word, v.n from d join v on v.word = d.rest
  union select v.word, d.word, d.n from d join v on v.word = d.rest
), best as (
  select word, count(*) as n_near, max(other_n) as top from near group by word
), form as materialized (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.top >= 10 * v.n then (select min(other) from near x where x.word = v.word and x.other_n = b.top) end as form,
    case when b.top >= 10 * v.n then b.top end as form_n
  from v left join best b using (word)
), chain(word, tip, k) as (
  select word, word, 0 from form
  union all select c.word, f.form, k + 1 from chain c join form f on f.word = c.tip where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from form f join (select word, arg_max(tip, k) as root from chain group by word) c using (word)
"""
