"""A class-based bigram language model with exchange clustering.

A token's probability is that of its class after the class before times that of the token in its class. The
most frequent words are exchanged: given how often each follows and precedes each class, a word moves where
the likelihood of the class bigrams gains most, the counts coming from the whole training text in every round.
Meanwhile rarer words stand in shapes (a hash of their last two bytes), which are exchanged like words. Then
every rarer word of the training text goes, by its own counts of neighbouring classes, to the class in which it
is likeliest. The rarest meet by word, each place with the two codes beside it, and go back to their documents with
count and class, so their number may grow with the text. Only words that the training text lacks keep their shape's class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import table, written

#: Words clustered singly, shapes of the others, classes besides that of the end, rounds.
SINGLE, SHAPES, CLASSES, ROUNDS = 8192, 256, 48, 3
#: Words whose counts and classes every task holds at most (the most frequent); the others' counts are joined.
LEXICON = 200_000
#: Distinct words a task counts before it passes the counts on, and items of a block of the statistics.
FLUSH, ITEMS = 300_000, 256
#: Tasks whose statistics are first added up.
LOT = 256
#: Weight of the class's own probability in that after another.
BETA = 10.0


def words(text: str | None) -> list[bytes]:
    """Bytes know only A-Z to lower and the six white-space characters."""
    return (text or "").encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c of every word; the end, counted once a text, is the empty word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode() for w in counts], "c": list(counts.values())})

        for batch in batches:
            for text in batch["text"]:
                counts.update(words(text))
                counts[b""] += 1
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return texts.select("text").mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def shape(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHAPES


def frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` words, none rarer than one left out, by falling count."""
    top = 4096
    counted = counts.where("word <> ''")
    histogram = {r["c"]: r["n"] for r in counted.groupBy(F.least("c", F.lit(top)).alias("c")).agg(F.count("*").alias("n")).collect()}
    least, total = top + 1, 0
    for c in range(top, 0, -1):
        total += histogram.get(c, 0)
        if total > most:
            break
        least = c
    if least > top:
        found = counted.orderBy(F.desc("c"), "word").limit(most).toPandas()
    else:
        found = counted.where(F.col("c") >= least).toPandas()
    return found.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, codes binary, log_sum double, rare array<string>, at array<int>, beside array<long>"


def coded(docs: DataFrame, lexicon: pd.DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, codes, log_sum, rare, at and beside: what the lexicon lacks, where it stands and the codes before (high half) and after.

    Codes (32 bits) are places in the lexicon; after them come the shapes of other words, and the end.
    """
    index = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(lexicon["word"])})
    shared = docs.sparkSession.sparkContext.broadcast(np.log10(lexicon["c"].to_numpy(np.float64) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, logs, n = index.value.get, shared.value, len(index.value)
        for batch in batches:
            rows, rare, places, beside = [], [], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                codes = np.full(len(tokens) + 1, n + SHAPES, np.int32)
                codes[:-1] = np.fromiter(map(get, tokens, repeat(-1)), np.int32, len(tokens))
                unknown = np.flatnonzero(codes < 0)
                known = codes[:-1] if not len(unknown) else codes[:-1][codes[:-1] >= 0]
                lacking = [tokens[i] for i in unknown.tolist()]
                codes[unknown] = [n + shape(w) for w in lacking]
                rare += lacking
                places.append(unknown.astype(np.int32))
                beside.append(np.where(unknown > 0, codes[unknown - 1], n + SHAPES).astype(np.int64) << 32 | codes[unknown + 1])
                rows.append((len(tokens) + 1, len(known), codes.astype("<i4").tobytes(), float(logs[known].sum())))
            ends = pa.array(np.cumsum([0] + [len(x) for x in places[1:]]), pa.int32())
            listed = (pa.array(rare, pa.binary()).cast(pa.string()), pa.array(np.concatenate(places)), pa.array(np.concatenate(beside)))
            n_tokens, n_known, held, sums = zip(*rows, strict=True) if rows else ((),) * 4
            made = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(held, pa.binary()), pa.array(sums, pa.float64())]
            made += [pa.ListArray.from_arrays(ends, x) for x in listed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], [f.split()[0] for f in CODED.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, CODED)


def class_statistics(codes: DataFrame, items: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each item follows and precedes each class; a text begins after an end. Items x classes, whatever the text's size.

    items: the item of each code; the last code and item are the end.
    """
    width, shared = int(classes.max()) + 1, codes.sparkSession.sparkContext.broadcast((items, classes))
    blocks = -(-len(classes) // ITEMS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_of, of = shared.value
        sums = np.zeros((2, blocks * ITEMS * width), np.int64)
        for batch in batches:
            item = item_of[np.concatenate([np.frombuffer(b, "<i4") for b in batch["codes"]] or [np.empty(0, np.int32)])].astype(np.int64)
            before = np.r_[len(of) - 1, item[:-1]][: len(item)]
            for way, (own, other) in enumerate(((item, before), (before, item))):
                sums[way] += np.bincount(own * width + of[other], minlength=sums.shape[1])
        parts = sums.reshape(2, blocks, -1)
        some = [(w, b) for w in range(2) for b in range(blocks) if parts[w, b].any()]
        lot = TaskContext.get().partitionId() // LOT
        if some:
            yield pd.DataFrame({"way": [w for w, _ in some], "block": [b for _, b in some], "lot": lot, "sums": [parts[w, b].astype("<i8").tobytes() for w, b in some]})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(ITEMS * width, np.int64)
        for b in group["sums"]:
            total += np.frombuffer(b, "<i8")
        return pd.DataFrame({"way": [key[0]], "block": [key[1]], "sums": [total.tobytes()]})

    made = codes.select("codes").mapInPandas(run, "way int, block int, lot int, sums binary")
    # First the tasks of a lot, then the lots: no group has a row of every task.
    lots = made.groupBy("way", "block", "lot").applyInPandas(add, "way int, block int, sums binary")
    got = lots.groupBy("way", "block").applyInPandas(add, "way int, block int, sums binary").toPandas()
    out = np.zeros((2, blocks, ITEMS * width), np.int64)
    for way, block, sums in got.itertuples(index=False):
        out[way, block] = np.frombuffer(sums, "<i8")
    return tuple(out.reshape(2, -1, width)[:, : len(classes)])


def exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Moves each item, most frequent first, to the class where the class bigrams' likelihood gains most; the end stays."""
    classes, width = classes.copy(), before.shape[1]
    h = lambda x: x * np.log(np.maximum(x, 1))
    pairs = np.zeros((width, width))
    np.add.at(pairs, classes, after.astype(float))
    own = width - 1
    for i in np.argsort(-before.sum(1), kind="stable"):
        left, right, n = before[i].astype(float), after[i].astype(float), float(before[i].sum())
        if i == len(classes) - 1 or not n:
            continue
        a = classes[i]
        pairs[a] = np.maximum(pairs[a] - right, 0)
        pairs[:, a] = np.maximum(pairs[:, a] - left, 0)
        rows, columns = pairs.sum(1), pairs.sum(0)
        gain = (h(pairs + right) - h(pairs)).sum(1) + (h(pairs + left[:, None]) - h(pairs)).sum(0)
        gain -= h(rows + right.sum()) - h(rows) + h(columns + n) - h(columns)
        gain[own] = -np.inf
        best = int(gain.argmax())
        best = best if gain[best] > gain[a] + 1e-9 else a
        classes[i] = best
        pairs[best] += right
        pairs[:, best] += left
    return classes


def likeliest(counts: DataFrame, key: str, steps: np.ndarray, tokens: np.ndarray) -> DataFrame:
    """key, class of the keys from counts (key, slot, n) of the classes before (slots from 0) and after (then)."""
    width = len(tokens)
    fit = np.concatenate([steps[:, :-1], steps.T[:, :-1]]), np.log10(tokens[:-1] + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = np.zeros((len(batch), 2 * width))
            for i, found in enumerate(batch["found"]):
                held[i, found % (2 * width)] = found // (2 * width)
            gain = held @ fit[0] - held[:, :width].sum(1)[:, None] * fit[1]
            yield pd.DataFrame({key: batch[key], "class": gain.argmax(1).astype(np.int32)})

    one = counts.groupBy(key).agg(F.collect_list(F.col("n") * F.lit(2 * width) + F.col("slot")).alias("found"))  # at most two a class
    return one.mapInPandas(run, f"{key} {dict(counts.dtypes)[key]}, class int")


def rarer(train: DataFrame, of_code: np.ndarray, first: int) -> DataFrame:
    """(code, slot, n): classes beside the codes from ``first`` on that are words of the lexicon."""
    end, shared = int(of_code[-1]), train.sparkSession.sparkContext.broadcast(of_code)
    slots = 2 * (end + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value.astype(np.int64)
        last = len(of) - SHAPES - 1
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            code = np.concatenate([np.frombuffer(b, "<i4") for b in batch["codes"]] or [np.empty(0, np.int32)]).astype(np.int64)
            at = np.flatnonzero((code >= first) & (code < last))  # never an end, by which each text is followed
            own = code[at] * slots
            new, n = np.unique(np.concatenate([own + np.where(at > 0, of[code[at - 1]], end), own + end + 1 + of[code[at + 1]]]), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > FLUSH:
                yield out(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out(keys, counts)

    def out(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"code": (keys // slots).astype(np.int32), "slot": (keys % slots).astype(np.int32), "n": counts})

    return train.select("codes").mapInPandas(run, "code int, slot int, n long").groupBy("code", "slot").agg(F.sum("n").alias("n"))


def placed(rows: DataFrame, of_code: np.ndarray, steps: np.ndarray, tokens: np.ndarray) -> DataFrame:
    """(row, at, class, c, first) of every place of a word that the lexicon lacks and the training text has: its likeliest class, its count, whether the place stands for the word.

    A word's places meet, the training text's decide. They are at most as many as those of a word of the lexicon.
    """
    shared = rows.sparkSession.sparkContext.broadcast(of_code)
    fit = np.ascontiguousarray(steps[:, :-1]), np.ascontiguousarray(steps.T[:, :-1]), np.log10(tokens[:-1] + 1)

    def likeliest_of(part: pa.Table) -> pa.RecordBatch:
        words_, beside = part.column("word").combine_chunks(), part.column("beside").to_numpy()
        starts = np.r_[0, np.flatnonzero(pc.not_equal(words_[1:], words_[:-1]).to_numpy(zero_copy_only=False)) + 1]
        learnt = ~part.column("held_out").to_numpy()
        gain = fit[0][shared.value[beside >> 32]] + fit[1][shared.value[beside & 0xFFFFFFFF]] - fit[2]
        gain[~learnt] = 0
        c = np.add.reduceat(learnt.astype(np.int64), starts)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(beside)]))
        first = np.zeros(len(beside), bool)
        first[starts] = True
        kept = np.flatnonzero(c[group] > 0)
        own = group[kept]
        columns = [part.column("row").to_numpy()[kept], part.column("at").to_numpy()[kept], np.add.reduceat(gain, starts).argmax(1).astype(np.int32)[own], c[own], first[kept]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "at", "class", "c", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word; the last word of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("word")
            if held and held[0].column("word")[0] != last[batch.num_rows - 1] or last[0] != last[batch.num_rows - 1]:
                whole = pc.index(last, last[batch.num_rows - 1]).as_py()
                yield likeliest_of(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held, batch = [], batch.slice(whole)
            held.append(batch)
        if held:
            yield likeliest_of(pa.Table.from_batches(held))

    found = rows.select("row", "held_out", F.explode(F.arrays_zip("rare", "at", "beside")).alias("x")).select(F.col("x.rare").alias("word"), "row", "held_out", "x.at", "x.beside")
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "row long, at int, class int, c long, first boolean")


def model(pairs: np.ndarray) -> np.ndarray:
    """log10 of each class's probability after each, from how often they follow."""
    tokens = pairs.sum(0)
    unigram = (tokens + 1) / (tokens.sum() + len(tokens))
    return np.log10((pairs + BETA * unigram) / (pairs.sum(1, keepdims=True) + BETA))


def score(documents: DataFrame, held: str = "pmod(crc32(cast(doc_id as string)), 7) = 2") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of every document.

    Learns from the documents that ``held`` is not true for. A null, empty or blank text is an end only. Rows
    without doc_id take no part; repeated rows are learnt from and scored each. Without training text every
    token is unknown. Other columns are left out. An empty table stays empty.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null").select("doc_id", "text", F.expr(held).alias("held_out"))
    counts = written(word_counts(docs.where("not held_out")), "word-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("ends")).first()
    n, v, ends = totals["n"] or 0, totals["v"] or 0, totals["ends"] or 0
    lexicon = frequent(counts, LEXICON)
    rows = written(coded(docs, lexicon).withColumn("row", F.monotonically_increasing_id()), "coded")
    train = rows.where("not held_out")

    single = min(SINGLE, len(lexicon))
    items = np.r_[np.arange(single), [single + shape(w.encode()) for w in lexicon["word"][single:]], single + np.arange(SHAPES + 1)].astype(np.int32)
    classes = np.r_[np.arange(single) % CLASSES, np.arange(SHAPES) % CLASSES, CLASSES].astype(np.int64)
    before, after = class_statistics(train, items, classes)
    for _ in range(ROUNDS):
        classes = exchange(classes, before, after)
        before, after = class_statistics(train, items, classes)
    pairs = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(pairs, classes, after.astype(float))

    # Every rarer word to its likeliest class beside classes as they are now.
    of_code, steps, tokens = classes[items].astype(np.uint8), model(pairs), pairs.sum(0)
    own = likeliest(rarer(train, of_code, single), "code", steps, tokens).toPandas()  # at most LEXICON rows
    rare = written(placed(rows, of_code, steps, tokens), "rare-places")
    of_code[own["code"].to_numpy(np.int64)] = own["class"].to_numpy(np.uint8)
    rarest = rare.groupBy("row").agg(
        F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"), F.count("*").alias("rare_known"), F.collect_list(F.col("at").cast("long") * CLASSES + F.col("class")).alias("placed")
    )
    shared = spark.sparkContext.broadcast(of_code)

    def to_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for codes, spots in batch[["codes", "placed"]].itertuples(index=False):
                c = shared.value[np.frombuffer(codes, "<i4")]
                if spots is not None:
                    c[spots // CLASSES] = spots % CLASSES
                made.append(c.tobytes())
            yield batch.drop(columns=["codes", "placed"]).assign(classes=made)

    plain = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, rare_sum double, rare_known long"
    wide = rows.join(rarest, "row", "left").select(*[f.split()[0] for f in plain.split(", ")], "codes", "placed")
    done = written(wide.mapInPandas(to_classes, plain + ", classes binary"), "classes")

    def widened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"codes": [np.frombuffer(c, np.uint8).astype("<i4").tobytes() for c in batch["classes"]]})

    same = np.arange(CLASSES + 1)
    pairs = class_statistics(done.where("not held_out").select("classes").mapInPandas(widened, "codes binary"), same.astype(np.int32), same)[1].astype(float)
    types = np.bincount(of_code[: len(lexicon)], minlength=CLASSES + 1).astype(float)
    for r in rare.where("first").groupBy("class").count().collect():
        types[r["class"]] += r["count"]
    types[CLASSES] = 1 if ends else 0
    value = spark.sparkContext.broadcast(model(pairs) - np.log10(pairs.sum(0) + types + 1))

    def class_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for held in batch["classes"]:
                c = np.frombuffer(held, np.uint8)
                sums.append(float(value.value[np.r_[CLASSES, c[:-1]], c].sum()))
            yield batch.drop(columns="classes").assign(class_sum=sums)

    scored = done.mapInPandas(class_part, plain + ", class_sum double")
    # Words that the training text lacks have count 0, whose logarithm after smoothing is 0.
    logs = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(float(np.log10(ends + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (logs + F.col("class_sum")).alias("score"),
    )


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
