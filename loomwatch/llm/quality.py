"""A quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are of characters, and every character of the trusted texts is a symbol of its own. Counts of all
orders, continuation counts, discounts and probabilities are made by joins of count tables that are sharded by
n-gram. A model of up to HELD n-grams is held whole by every task, so scoring a document looks its n-grams up
instead of shuffling them; of a larger one tasks hold the n-grams of the most frequent characters, and the
others are joined. A document is rejected if its perplexity exceeds its
language's quantile of all trusted documents that the model has not seen; quantiles come from counts of
perplexities in narrow bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwatch.llm.common import few, same_keys, table, written

#: Symbols of the dense table (and at least of the model), those of them that characters which the trusted texts lack share by their block of 128 code points, characters of an n-gram.
ALPHABET, SHARED, ORDER = 64, 8, 4
#: Bits of a symbol in a context, n-grams of a model that tasks hold whole.
BITS, HELD = 21, 1 << 22
MASK = (1 << BITS) - 1
#: The model is fitted on all trusted documents with even hashes of their id, and all others set thresholds. A caller may bound the first (in the order of the hash); the rest then set thresholds too.
SAMPLE: int | None = None
#: Bins of a perplexity that doubles.
BINS = 1000
#: Trusted documents of its own that a language needs for a threshold of its own, and the quantile.
LEAST, QUANTILE = 50, 0.995
#: Least discount, so that nothing is impossible where counts of counts give none.
LEAST_DISCOUNT = 0.05


def good_ids(labels: DataFrame) -> DataFrame:
    """of, h: documents labelled good and not toxic, with a hash of the id."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("doc_id is not null and q = 1 and t = 0")
    return written(good.select(F.col("doc_id").alias("of"), F.xxhash64("doc_id", F.lit(23)).alias("h")), "good")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str, alphabet: np.ndarray) -> np.ndarray:
    """The text's symbols between ORDER - 1 line ends and one; characters outside the alphabet (sorted) share symbols below SHARED."""
    points = np.concatenate([np.full(ORDER - 1, 10, np.uint32), code_points(text), np.array([10], np.uint32)])
    others = (points // 128 % SHARED).astype(np.int64)
    if not len(alphabet):
        return others
    at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
    return np.where(alphabet[at] == points, at + SHARED, others)


def windows(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context (ORDER - 1 symbols of BITS bits) and last symbol of every n-gram."""
    context = np.zeros(len(s) - ORDER + 1, np.int64)
    for i in range(ORDER - 1):
        context = context << BITS | s[i : len(s) - ORDER + 1 + i]
    return context, s[ORDER - 1 :]


def counted(context: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    """context, last, n: the distinct n-grams."""
    of, at = np.unique(context, return_inverse=True)
    found, n = np.unique(at.astype(np.int64) << BITS | last, return_counts=True)
    return pd.DataFrame({"context": of[found >> BITS], "last": found & MASK, "n": n})


def characters(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts and the line end, sorted by code point, and how often each occurs; there are no more than Unicode has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, n = np.unique(np.concatenate([code_points(t + "\n") for t in batch["text"]]), return_counts=True)
            yield pd.DataFrame({"point": found.astype(np.int64), "n": n})

    counts = texts.select("text").mapInPandas(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).toPandas().sort_values("point")
    return counts["point"].to_numpy(np.uint32), counts["n"].to_numpy(np.int64)


def gram_counts(texts: DataFrame, alphabet: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [windows(symbols(t, alphabet)) for t in batch["text"]]
            yield counted(np.concatenate([c for c, _ in found]), np.concatenate([x for _, x in found]))

    return texts.select("text").mapInPandas(run, "context long, last long, n long").groupBy("context", "last").agg(F.sum("n").alias("n"))


def without_first(context: str, order: int) -> Column:
    """What an n-gram of that order has of a longer context: its last order - 1 symbols."""
    return F.col(context).bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1).cast("long"))


def order_model(counts: DataFrame, order: int, lower: DataFrame | None, size: int) -> tuple[DataFrame, DataFrame]:
    """(context, last, p) and (context, weight of the lower order) of one order, by joins on contexts and suffixes."""
    of = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    n1, n2, n3, n4 = counts.agg(*of).first()
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [max(LEAST_DISCOUNT, k - (k + 1) * y * more / n) if n else LEAST_DISCOUNT for k, n, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    cut = F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
    cut = F.least(cut, F.col("n").cast("double"))
    rows = counts.select("context", "last", "n", cut.alias("cut"))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
    joined = rows.join(contexts, "context")
    if lower is None:
        joined = joined.withColumn("below", F.lit(1.0 / size))
    else:
        joined = joined.withColumn("suffix", without_first("context", order - 1)).join(lower.select(F.col("context").alias("suffix"), "last", F.col("p").alias("below")), ["suffix", "last"])
    p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("below")
    return joined.select("context", "last", p.alias("p")), contexts.select("context", "weight")


class Model:
    """Per order n-grams with p and contexts with their weight, of all characters of the trusted texts.

    The dense table of the highest order over the ALPHABET most frequent symbols is made once a task; n-grams with
    another symbol are searched in the sorted ones. If there are more n-grams than HELD, only those of the frequent
    symbols are here, and ``tables`` has all of them by order for joins.
    """

    def __init__(self, alphabet: np.ndarray, frequent: np.ndarray, size: int, orders: list[tuple[pd.DataFrame, pd.DataFrame]], tables: list[tuple[DataFrame, DataFrame]] | None = None):
        self.alphabet, self.size, self.tables, self.joined, self.dense, self.orders = alphabet, size, tables, bool(tables), None, []
        self.code = np.full(SHARED + len(alphabet), -1, np.int64)
        self.code[:SHARED], self.code[frequent] = np.arange(SHARED), np.arange(SHARED, SHARED + len(frequent))
        for grams, contexts in orders:
            contexts = contexts.sort_values("context")
            context = contexts["context"].to_numpy(np.int64)
            key = np.searchsorted(context, grams["context"].to_numpy(np.int64)) << BITS | grams["last"].to_numpy(np.int64)
            by = np.argsort(key)
            self.orders.append((context, contexts["weight"].to_numpy(np.float32), key[by], grams["p"].to_numpy(np.float32)[by]))

    def __getstate__(self):
        return self.__dict__ | {"tables": None, "dense": None}  # tasks have no use for tables

    def coded(self, context: np.ndarray, n: int) -> np.ndarray:
        """The place in the dense table of n symbols; below 0 if one is not frequent."""
        out, ok = np.zeros(len(context), np.int64), np.ones(len(context), bool)
        for i in range(n - 1, -1, -1):
            code = self.code[context >> BITS * i & MASK]
            out, ok = out * ALPHABET + code, ok & (code >= 0)
        return np.where(ok, out, -1)

    def table(self) -> np.ndarray:
        """Bits of every n-gram's last character after the others, of the frequent symbols."""
        if self.dense is None:
            below = np.full(1, 1.0 / self.size, np.float32)
            for order, (context, weight, key, p) in enumerate(self.orders, 1):
                weights, at = np.ones(ALPHABET ** (order - 1), np.float32), self.coded(context, order - 1)
                weights[at[at >= 0]] = weight[at >= 0]
                now = np.repeat(weights, ALPHABET)
                shaped = now.reshape(-1, len(below)) if order > 1 else now
                shaped *= below  # the row of every first character; in place, for the last table is large
                first, last = at[key >> BITS], self.code[key & MASK]
                here = (first >= 0) & (last >= 0)
                now[first[here] * ALPHABET + last[here]] = p[here]
                below = now
            np.log2(below, out=below)
            self.dense = np.negative(below, out=below)
        return self.dense

    def searched(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Bits of n-grams of any symbols."""
        out = np.full(len(last), 1.0 / self.size)
        for order, (contexts, weight, key, p) in enumerate(self.orders, 1):
            own = context & ((1 << BITS * (order - 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, own), max(len(contexts) - 1, 0))
            known = contexts[at] == own if len(contexts) else np.zeros(len(own), bool)
            if not known.any():
                continue
            out[known] *= weight[at[known]]
            wanted = at << BITS | last
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            seen = known & (key[place] == wanted)
            out[seen] = p[place[seen]]
        return -np.log2(out)

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the dense table of the n-grams of frequent symbols, contexts and last symbols of the others."""
        s = symbols(text, self.alphabet)
        code = self.code[s]
        rare = code < 0
        n, place, other = len(s) - ORDER + 1, 0, False
        for i in range(ORDER):
            place, other = place * ALPHABET + code[i : n + i], other | rare[i : n + i]
        if not other.any():
            return place, s[:0], s[:0]
        context, last = windows(s)
        return place[~other], context[other], last[other]

    def bits(self, text: str) -> tuple[float, int]:
        """Bits of the n-grams that are held here, and the number of all n-grams."""
        place, context, last = self.split(text)
        out = float(self.table()[place].sum(dtype=np.float64))
        if len(last) and not self.joined:
            out += float(self.searched(context, last).sum())
        return out, len(place) + len(last)

    def perplexity(self, text: str | None) -> float | None:
        if not text:
            return None
        bits, n = self.bits(text)
        return float(2.0 ** (bits / n))


def train(texts: DataFrame) -> Model:
    """The model of the column text of non-empty texts; uniform if there are none."""
    alphabet, used = characters(texts)
    frequent = np.sort(np.argsort(-used, kind="stable")[: ALPHABET - SHARED]) + SHARED
    size = max(ALPHABET, SHARED + len(alphabet))
    counts = {ORDER: written(gram_counts(texts, alphabet), "grams")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = written(counts[order + 1].select(without_first("context", order).alias("context"), "last").groupBy("context", "last").agg(F.count("*").alias("n")), "grams")
    joined = counts[ORDER].count() > HELD
    orders, tables, lower = [], [], None
    for order in range(1, ORDER + 1):
        found, contexts = order_model(counts[order], order, lower, size)
        lower = written(found, "order")
        grams = lower
        if joined:
            contexts = written(contexts, "contexts")
            tables.append((lower, contexts))
            few_of = lambda c, n: reduce(lambda p, q: p & q, [F.shiftright(c, BITS * i).bitwiseAND(F.lit(MASK)).isin([*range(SHARED), *frequent.tolist()]) for i in range(n)], F.lit(True))
            grams, contexts = lower.where(few_of("context", order - 1) & few_of("last", 1)), contexts.where(few_of("context", order - 1))
        orders.append((grams.toPandas(), contexts.toPandas()))  # at most HELD rows, or those of ALPHABET symbols, whatever the corpus
    return Model(alphabet, frequent, size, orders, tables if joined else None)


def rest_bits(documents: DataFrame, model: Model) -> DataFrame:
    """key (of a text), rest: bits of each text's n-grams with symbols that are not frequent, by joins with the model's tables."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                _, context, last = model.split(text)
                if len(last):
                    yield counted(context, last).assign(key=key)

    found = documents.where("text <> ''").select(text_key().alias("key"), "text").mapInPandas(run, "key string, context long, last long, n long")
    found = written(found.dropDuplicates(["key", "context", "last"]), "rest")
    grams = found.select("context", "last").distinct().withColumn("p", F.lit(1.0 / model.size))
    for order, (probabilities, contexts) in enumerate(model.tables, 1):
        probabilities, contexts = probabilities.select(F.col("context").alias("own"), "last", F.col("p").alias("seen")), contexts.withColumnRenamed("context", "own")
        if order == 1:
            probabilities, contexts = F.broadcast(probabilities), F.broadcast(contexts)  # no more than there are characters
        grams = grams.withColumn("own", without_first("context", order)).join(contexts, "own", "left").join(probabilities, ["own", "last"], "left")
        grams = grams.select("context", "last", F.coalesce("seen", F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
    return found.join(grams, ["context", "last"]).groupBy("key").agg(F.sum(-F.col("n") * F.log2("p")).alias("rest"))


def text_key() -> Column:
    return F.sha2("text", 256)


def with_perplexity(documents: DataFrame, model: Model, out: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("bits double, n long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            yield pd.DataFrame([model.bits(t) if t else (None, None) for t in texts], columns=["bits", "n"]).astype({"bits": "float64", "n": "Int64"})
        model.dense = None  # the worker goes on to other work

    scored = documents.withColumn("__held", score(F.col("text")))
    bits = F.col("__held.bits")
    if model.tables:
        scored = scored.withColumn("__key", text_key()).join(rest_bits(documents, model).withColumnsRenamed({"key": "__key", "rest": "__rest"}), "__key", "left")
        bits = bits + F.coalesce("__rest", F.lit(0.0))
    return scored.withColumn(out, F.pow(F.lit(2.0), bits / F.col("__held.n"))).drop("__held", "__key", "__rest")


def classify(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents with perplexity, threshold and keep.

    A language with fewer than LEAST trusted documents, null among them, has the threshold of all. Null and
    empty texts have no perplexity and are not kept. Without trusted documents there is no threshold and
    every other text is kept. Repeated rows are judged alike, rows without id like others. Columns named like
    the added ones are replaced. An empty table stays empty.
    """
    good = good_ids(labels)
    even = F.pmod("h", F.lit(2)) == 0
    if SAMPLE is None:
        fit, others = good.where(even).select("of"), good.where(~even)
    else:
        fit = written(good.where(even).orderBy("h", "of").limit(SAMPLE).select("of"), "fitted")
        others = good.join(few(fit), "of", "left_anti")
    docs = documents.drop("perplexity", "threshold", "keep")
    plain = docs.select("doc_id", "lang", "text").where("text <> ''")
    model = train(written(plain.join(few(fit), F.col("doc_id") == F.col("of")).select("text"), "trusted"))

    # Only ids, languages and bins are shuffled, so all trusted documents can be looked at.
    unseen = others.select(F.col("of").alias("doc_id"))
    bins = with_perplexity(plain, model, "x").select("doc_id", "lang", binned(F.col("x")).alias("bin")).join(unseen, "doc_id")
    bins = written(bins.groupBy("lang", "bin").agg(F.count("*").alias("n")), "bins")
    common = at_quantile(bins.groupBy(F.lit(1).alias("all"), "bin").agg(F.sum("n").alias("n")), "all", quantile, 1).first()
    own = at_quantile(bins, "lang", quantile, LEAST).withColumnsRenamed({"lang": "of_lang", "limit": "own"})
    scored = with_perplexity(docs, model, "perplexity").join(F.broadcast(own), same_keys(["lang"], ["of_lang"]), "left")
    limit = F.coalesce("own", F.lit(common["limit"] if common else None).cast("long"))
    keep = F.coalesce(F.col("perplexity").isNotNull() & (limit.isNull() | (binned(F.col("perplexity")) <= limit)), F.lit(False))
    return scored.select(*docs.columns, "perplexity", F.pow(F.lit(2.0), limit / BINS).alias("threshold"), keep.alias("keep"))


def binned(perplexity: Column) -> Column:
    return F.ceil(F.log2(perplexity) * BINS)


def at_quantile(bins: DataFrame, key: str, quantile: float, least: int) -> DataFrame:
    """key, limit: the first bin up to which a key of at least ``least`` documents has the quantile of them; a key has few bins."""
    up_to = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = bins.withColumns({"up_to": F.sum("n").over(up_to), "of": F.sum("n").over(Window.partitionBy(key))})
    return counted.where((F.col("of") >= least) & (F.col("up_to") >= F.col("of") * quantile)).groupBy(key).agg(F.min("bin").alias("limit"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs.select("doc_id", "text", "lang"), labels).select("doc_id", "lang", "perplexity", "threshold", "keep")
