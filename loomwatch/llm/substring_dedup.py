"""Removing long repeated substrings with suffix arrays by linear grouping.

Every window of ``length`` bytes has one anchor: where the smallest hash of a shorter gram lies in it. Equal
windows have equal anchors at the same place, so only anchors whose gram occurs twice can lie in a repeat.
The windows of one anchor occurrence follow one another; their context is the bytes that they cover. Contexts
that occur twice are repeated whole. The other contexts of a gram meet in one part, where the gram, which
they share, counts as one symbol; a suffix array over them shows at each start whether a neighbour agrees to
the window's end. A gram with too many contexts for one array is halved first: windows that reach far to the
left of the gram by the bytes that they then share there, the others by those on its right. What of a context
is sorted is what windows can need whose bytes next to the gram another context of its part has too.

The suffix array is made by grouping. Suffixes with one first symbol are a group; groups are taken from the
highest down, and the previous smaller suffix of each member is moved to a new group whose prefix is longer
by the member's, so that in the end each group shares its longest Lyndon prefix. Then suffixes are taken in
order, and each puts the suffixes whose Lyndon prefix ends where it begins into the next place of their
group. Nothing is renamed and no smaller string is sorted.

Passages that are shorter in bytes stay, but are counted in words: windows of ``WORDS`` words that another text
has too. Their anchors are found as above, over hashes of words. Contexts that two texts have are settled whole by
64-bit hashes; the windows of the others meet, by such hashes too, with one of each settled context of their gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import WORD, few, join_counted, table, written

#: Bytes of an anchor's gram, of a repeat; contexts of a part that are sorted at once at most; symbols of one suffix array.
GRAM, LENGTH, MOST, SYMBOLS = 300, 400, 500, 200_000
#: Bands of places of a gram in its windows; a context is sorted where a band's least bytes are another's too.
BANDS = 10
#: Words of a passage at least, of an anchor's gram of words; the fewest bytes that hold such a passage.
WORDS, WORD_GRAM = 51, 20
WORDS_BYTES = 2 * WORDS - 1
#: Bytes of a text that are hashed at once; of short texts whose words are.
SEGMENT, GROUP = 1 << 22, 1 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = np.uint64(0x9E3779B97F4A7C15)
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
PLACE = np.uint64(0xFFFFFF)


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in order, a proper prefix before what it begins."""
    n = len(s)
    members: list[list[int]] = []
    of = [0] * n
    firsts: dict[int, list[int]] = {}
    for i, x in enumerate(s):
        firsts.setdefault(x, []).append(i)
    for x in sorted(firsts):
        for i in firsts[x]:
            of[i] = len(members)
        members.append(firsts[x])
    above = [*range(1, len(members)), -1]
    below = list(range(-1, len(members) - 1))
    size, left = [1] * len(members), [len(m) for m in members]
    smaller = list(range(-1, n - 1))  # nearest earlier suffix that may be in a lower group
    done = bytearray(n)
    group, final = len(members) - 1, []
    while group >= 0:
        own = [i for i in members[group] if of[i] == group]
        if len(own) == 1:  # as below, for the most frequent case
            k = i = own[0]
            done[i] = 1
            j = smaller[i]
            while j >= 0 and done[j]:
                j = smaller[j]
            while (m := smaller[k]) != j:
                smaller[k] = j
                k = m
            if j >= 0:
                old = of[j]
                if left[old] == 1:
                    size[old] += size[group]
                else:
                    left[old] -= 1
                    of[j] = new = len(members)
                    members.append([j])
                    left.append(1)
                    size.append(size[old] + size[group])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = below[up] = new
            members[group] = own
            final.append(group)
            group = below[group]
            continue
        for i in own:
            done[i] = 1
        counts: dict[int, int] = {}
        for i in own:
            j = smaller[i]
            while j >= 0 and done[j]:
                j = smaller[j]
            k = i
            while (m := smaller[k]) != j:  # shorten the way
                smaller[k] = j
                k = m
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in counts.items():
            moved.setdefault((of[j], -times), []).append(j)
        for old, times in sorted(moved):  # more repetitions stand higher; each goes right above the old group
            js = moved[old, times]
            if len(js) == left[old]:  # all that are left of a group stay together
                size[old] -= times * size[group]
                continue
            new = len(members)
            members.append(js)
            left[old] -= len(js)
            left.append(len(js))
            size.append(size[old] - times * size[group])
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            below[up] = new
            for j in js:
                of[j] = new
        if own:
            members[group] = own
            final.append(group)
        group = below[group]
    place, at = {}, 0
    for g in reversed(final):
        place[g] = at
        at += len(members[g])
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        ends[i + size[of[i]]].append(i)
    order = [0] * n
    for i in ends[n]:
        g = of[i]
        order[place[g]] = i
        place[g] += 1
    for at in range(n):
        for i in ends[order[at]]:
            g = of[i]
            order[place[g]] = i
            place[g] += 1
    return order


class Hashes:
    """Hashes of all windows of a byte string, or of a row of hashes, of any lengths."""

    scramble = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + ONE
    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes.powers) < n + 1:
            for name, x in (("powers", BASE), ("inverses", np.uint64(pow(int(BASE), -1, 1 << 64)))):
                row = np.full(n + 1, x, np.uint64)
                row[0] = 1
                setattr(Hashes, name, np.multiply.accumulate(row))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.scramble[data] if data.dtype == np.uint8 else data) * self.powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray | slice, lengths: np.ndarray | int, salt: np.ndarray | int = 0) -> np.ndarray:
        raw = (self.sums[starts + lengths] - self.sums[starts]) * self.inverses[starts]
        return self.mixed(raw + np.asarray(salt).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return self.mixed((self.sums[length:] - self.sums[:n]) * self.inverses[:n])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each ``width`` values lies, the first of equal ones."""
    n = len(values)
    held = np.full(-(-n // width) * width, ALL)
    held[:n] = (values & ~PLACE) | np.arange(n, dtype=np.uint64)
    held = held.reshape(-1, width)
    from_left = np.minimum.accumulate(held, 1).ravel()
    from_right = np.minimum.accumulate(held[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(from_right[: n - width + 1], from_left[width - 1 : n]) & PLACE).astype(np.int64)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, number of starts, offset of the anchor from the first start, gram's hash, context's hash) of the windows, by anchor."""
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        hashes = Hashes(part)
        grams = hashes.all(gram)
        place = least_places(grams, length - gram + 1)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        n = np.diff(np.r_[first, len(place)])
        lead = place[first] - first
        yield first + at, n, lead, grams[place[first]], hashes.of(first, n + length - 1, lead * 65536 + n)


def data_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


ANCHOR = "tid long, start long, n int, lead int, gram long, context long"


def anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pd.DataFrame:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return pd.DataFrame(dict(zip(["tid", "start", "n", "lead", "gram", "context"], columns, strict=True)))

        for batch in batches:
            for tid, text in batch.itertuples(index=False):
                for start, n, lead, gram, context in anchors(data_of(text)):
                    held.append((np.full(len(n), tid), start, n, lead, gram.view(np.int64), context.view(np.int64)))
                if len(held) >= 2000:
                    yield out()
        if held:
            yield out()

    return texts.select("tid", "text").mapInPandas(run, ANCHOR)


def context_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (tid, start, n, lead and more), the gram left out: left and right of it."""
    more = [f for f in wanted.columns if f != "tid"]
    per_text = wanted.groupBy("tid").agg(F.collect_list(F.struct(*more)).alias("contexts"))  # within one text

    def cut(c: Column) -> Column:
        right = F.substring(F.col("data"), (c["start"] + c["lead"] + GRAM + 1).cast("int"), c["n"] + LENGTH - 1 - c["lead"] - GRAM)
        return F.struct(*[c[m].alias(m) for m in more], F.substring(F.col("data"), (c["start"] + 1).cast("int"), c["lead"]).alias("left"), right.alias("right"))

    found = texts.select("tid", F.col("text").cast("binary").alias("data")).join(per_text, "tid")
    return found.select("tid", F.inline(F.transform("contexts", cut)))


def sorted_repeats(lefts: list[bytes], rights: list[bytes], grams: list[int]) -> list[list[int]]:
    """For each context the places of its left part, its end included, from which a window is found elsewhere among the contexts."""
    window = LENGTH - GRAM + 1
    symbols: list[int] = []
    starts = []
    names = {g: 257 + i for i, g in enumerate(dict.fromkeys(grams))}
    for left, right, g in zip(lefts, rights, grams, strict=True):
        starts.append(len(symbols))
        symbols += [1 + b for b in left]
        symbols.append(names[g])
        symbols += [1 + b for b in right]
        symbols.append(0)
    order, text = np.array(suffix_array(symbols), np.int64), np.array(symbols, np.int32)
    valid = np.zeros(len(text), bool)
    for begin, left, right in zip(starts, lefts, rights, strict=True):
        valid[begin : begin + max(0, min(len(left) + 1, len(left) + len(right) + 2 - window))] = True
    # Neighbours in order whose windows are equal, compared symbol by symbol.
    one = np.flatnonzero(valid[order[:-1]] & valid[order[1:]])
    for d in range(window - 1, -1, -1):
        one = one[text[order[one] + d] == text[order[one + 1] + d]]
    met = np.zeros(len(text), bool)
    met[order[one]] = met[order[one + 1]] = True
    return [np.flatnonzero(met[begin : begin + len(left) + 1]).tolist() for begin, left in zip(starts, lefts, strict=True)]


def cut_to_shared(lefts: list[bytes], rights: list[bytes], parts: list[int]) -> list[tuple[int, int, int]]:
    """(context, bytes of its left part, bytes of its right part) that windows can need which another context of its part has too.

    A window has 0 to LENGTH - GRAM bytes on the left of the gram and the others on its right. Windows with numbers
    of one band all hold the band's least bytes left and right of the gram; where no other context has these, none
    of the band's windows is found elsewhere. Bytes are compared. Windows of the outermost bands that are left, and
    of those between, stay whole.
    """
    width = LENGTH - GRAM
    bands = [(b.start, b.stop - 1) for i in range(BANDS) if (b := range((width + 1) * i // BANDS, (width + 1) * (i + 1) // BANDS))]
    held: list[list[tuple]] = []
    times: dict[tuple, int] = {}
    for left, right, part in zip(lefts, rights, parts, strict=True):
        keys = []
        for low, high in bands:
            if max(low, width - len(right)) <= min(high, len(left)):
                keys.append((part, low, high, left[len(left) - low :], right[: width - high]))
                times[keys[-1]] = times.get(keys[-1], 0) + 1
        held.append(keys)
    out = []
    for i, keys in enumerate(held):
        found = [k for k in keys if times[k] > 1]
        if found:
            out.append((i, min(len(lefts[i]), found[-1][2]), min(len(rights[i]), width - found[0][1])))
    return out


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]


SPAN = "tid long, a long, b long"


def solved(rows: DataFrame) -> DataFrame:
    """Spans of the rows (tid, start, times, part, gram, left, right) that are repeated within their part, by suffix arrays."""

    def by_sorting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by part; parts share a suffix array until it has enough symbols."""

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            lefts, rights, parts = rows["left"].to_list(), rows["right"].to_list(), rows["part"].to_list()
            some = cut_to_shared(lefts, rights, parts)
            found = sorted_repeats([lefts[i][len(lefts[i]) - a :] for i, a, _ in some], [rights[i][:b] for i, _, b in some], [parts[i] for i, *_ in some])
            own = rows[["tid", "start", "times"]].to_numpy()
            out = [np.empty((0, 3), np.int64)]
            for (i, a, _), at in zip(some, found, strict=True):
                tid, start, times = own[i].tolist()
                if at and times == 1:
                    first, last = runs(np.array(at) + start + len(lefts[i]) - a)
                    out.append(np.stack([np.full(len(first), tid), first, last + LENGTH], 1))
            return pd.DataFrame(np.concatenate(out), columns=["tid", "a", "b"])

        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while True:
                sizes = (held["left"].map(len) + held["right"].map(len) + 2).cumsum().to_numpy()
                ends = np.flatnonzero(held["part"].to_numpy()[1:] != held["part"].to_numpy()[:-1]) + 1
                full = ends[sizes[ends - 1] >= SYMBOLS]
                if not len(full):
                    break
                yield solve(held.iloc[: full[0]])
                held = held.iloc[full[0] :].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    work = rows.agg(F.sum(F.length("left") + F.length("right") + 2)).first()[0] or 0
    tasks = -(-work // SYMBOLS) + 1  # the work is long for its bytes, by which Spark would deal it
    return rows.select("tid", "start", "times", "part", "left", "right").repartition(tasks, "part").sortWithinPartitions("part").mapInPandas(by_sorting, SPAN)


def halves(rows: DataFrame) -> DataFrame:
    """The rows of parts (part, low, high) in the two halves of each.

    A window has ``before`` bytes on the left of the gram, low to high in a part. Windows of the upper half all
    hold the bytes just left of the gram, those of the lower half the bytes just right of it: what two contexts
    share in a half they share with these bytes, which name the new part.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    near_left = F.substring("left", F.greatest(F.col("lead") - middle, F.lit(1)), F.lit(LENGTH))
    near_right = F.substring("right", F.lit(1), LENGTH - GRAM - middle)
    upper = F.struct(F.xxhash64("part", F.lit(1), near_left).alias("part"), (middle + 1).alias("low"), F.col("high").alias("high"))
    lower = F.struct(F.xxhash64("part", F.lit(0), near_right).alias("part"), F.col("low").alias("low"), middle.alias("high"))
    both = F.array_compact(F.array(F.when(F.col("lead") > middle, upper), F.when(F.col("lead") - F.col("n") + 1 <= middle, lower)))
    return rows.select(*[c for c in rows.columns if c not in ("part", "low", "high")], F.inline(both))


def split_repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of parts of at most MOST contexts, and spans that were found on the way, from rows of larger parts.

    A part is halved as often as it takes. Contexts of a part that agree in all its windows repeat each other
    and one goes on for them; a part with one window left has none that differ, so the halving ends.
    """
    parts, spans = [], []
    width = LENGTH - GRAM
    for _ in range(width.bit_length()):
        rows = halves(rows)
        # What of the context the part's windows cover.
        most, least = F.least("lead", "high"), F.greatest(F.col("lead") - F.col("n") + 1, F.col("low"))
        left, right = F.substring("left", F.col("lead") - most + 1, most), F.substring("right", F.lit(1), width - least)
        same = [F.xxhash64(most, least, left, right, F.lit(i)).alias(f"same{i}") for i in (1, 2)]
        rows = written(rows.select("*", most.alias("most"), least.alias("least"), *same), "halves")
        keys = ["part", "low", "high", "same1", "same2"]
        of = [c for c in rows.columns if c not in keys]
        met = written(rows.groupBy(*keys).agg(F.count("*").alias("met"), F.min(F.struct("tid", "start", *[c for c in of if c not in ("tid", "start")])).alias("row")), "met")
        whole = join_counted(rows.where("times = 1"), met.where("met > 1").select(*keys, "met"), keys, "met")
        spans.append(whole.select("tid", (F.col("start") + F.col("lead") - F.col("most")).alias("a"), (F.col("start") + F.col("lead") - F.col("least") + LENGTH).alias("b")))
        one = met.select("part", "low", "high", "row.*", "met").withColumn("times", F.when(F.col("met") > 1, F.lit(2)).otherwise(F.col("times"))).drop("met", "most", "least")
        counted = one.groupBy("part").agg(F.count("*").alias("of")).where("of > 1")
        rows = written(join_counted(one, counted, ["part"], "of"), "split")
        parts.append(rows.where(F.col("of") <= MOST).drop("of"))
        rows = rows.where((F.col("of") > MOST) & (F.col("low") < F.col("high"))).drop("of")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, spans)


def of_grams(rows: DataFrame, grams: DataFrame, most: int = 1024, parts: int = 64) -> DataFrame:
    """The rows whose gram is one of the grams (gram, times), each of these once; rows are read once.

    Rows of the ``most`` grams with most rows are dealt to ``parts`` parts of their gram, so no task gets all of them.
    """
    busy = F.broadcast(grams.orderBy(F.desc("times"), "gram").limit(most).select("gram", F.lit(True).alias("busy")))
    dealt = rows.join(busy, "gram", "left").withColumn("part", F.when(F.col("busy"), F.pmod(F.xxhash64("tid", "start"), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
    each = F.when(F.col("busy"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    wanted = grams.join(busy, "gram", "left").select("gram", F.explode(each).alias("part"))
    return dealt.join(wanted, ["gram", "part"]).select(*rows.columns)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tid, a, b): bytes a to b (exclusive) of the texts (tid, text), all different, that lie in repeats; spans may overlap."""
    grams = written(anchor_rows(texts).select("gram").groupBy("gram").agg(F.count("*").alias("times")).where("times > 1"), "grams")
    alive = written(of_grams(anchor_rows(texts), grams), "anchors")

    contexts = alive.groupBy("gram", "context").agg(F.count("*").alias("times"), F.min(F.struct("tid", "start", "n", "lead")).alias("first"))
    contexts = written(contexts, "contexts")
    whole = join_counted(alive, contexts.where("times > 1").select("gram", "context", "times"), ["gram", "context"], "times")
    spans = whole.select("tid", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))

    several = contexts.groupBy("gram").agg(F.count("*").alias("of"), F.count_if(F.col("times") == 1).alias("open")).where("of > 1 and open > 0").select("gram", "of")
    some = join_counted(contexts, several, ["gram"], "of").select(F.col("gram").alias("part"), "times", "of", "first.*")
    found = written(context_texts(texts, some), "context-texts")
    rows = found.where(F.col("of") <= MOST).drop("of", "n", "lead")
    large = found.where(F.col("of") > MOST).drop("of")
    if not large.isEmpty():
        parts, more = split_repeats(large.withColumns({"low": F.lit(0), "high": F.lit(LENGTH - GRAM)}))
        rows, spans = rows.unionByName(parts.select(*rows.columns)), spans.unionByName(more)
    return spans.unionByName(solved(rows))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and where the words of each text begin, the end included."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, SPACE[data], True]))
    first, last = edges[::2], edges[1::2]
    out, i = np.empty(len(first), np.uint64), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + SEGMENT, "right")))
        out[i:j] = Hashes(data[first[i] : last[j - 1]]).of(first[i:j] - first[i], last[i:j] - first[i:j])
        i = j
    return out, np.r_[0, np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))]


def word_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the text, first start in it, number of starts, gram's hash, context's hash) of the texts' windows of words, by anchor."""
    words, begins = word_hashes(texts)
    hashes = Hashes(words)
    for start, n, lead, gram, _ in anchors(words, WORDS, WORD_GRAM):
        of = np.searchsorted(begins, start + lead, "right") - 1  # the text of the gram; windows that leave it are cut off
        low, high = np.maximum(start, begins[of]), np.minimum(start + n, begins[of + 1] - WORDS + 1)
        own = high > low
        of, low, n, lead = of[own], low[own], (high - low)[own], (start + lead - low)[own]
        yield of, low - begins[of], n, gram[own], hashes.of(low, n + WORDS - 1, lead * 65536 + n)


def in_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows (text and more) in groups of about GROUP characters or one text."""
    for batch in batches:
        group = batch["text"].str.len().cumsum() // GROUP
        for _, rows in batch.groupby(group, sort=False):
            yield rows


def word_anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in in_groups(batches):
            tids = rows["tid"].to_numpy()
            for of, start, n, gram, context in word_anchors([t.encode() for t in rows["text"]]):
                yield pd.DataFrame({"tid": tids[of], "start": start, "n": n, "gram": gram.view(np.int64), "context": context.view(np.int64)})

    return texts.select("tid", "text").mapInPandas(run, "tid long, start long, n int, gram long, context long")


def word_window_rows(texts: DataFrame) -> DataFrame:
    """(tid, start, settled, gram): the windows of words of the texts' runs (starts, ns, settled), keyed by the hash of their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in in_groups(batches):
            words, begins = word_hashes([t.encode() for t in rows["text"]])
            runs = rows["starts"].map(len).to_numpy()
            starts, ns = np.concatenate(rows["starts"].to_list()), np.concatenate(rows["ns"].to_list())
            start = np.repeat(starts - (np.cumsum(ns) - ns), ns) + np.arange(ns.sum())
            of, settled = np.repeat(np.repeat(np.arange(len(rows)), runs), ns), np.repeat(np.concatenate(rows["settled"].to_list()), ns)
            yield pd.DataFrame({"tid": rows["tid"].to_numpy()[of], "start": start, "settled": settled, "gram": Hashes(words).of(begins[of] + start, WORDS).view(np.int64)})

    return texts.select("tid", "text", "starts", "ns", "settled").mapInPandas(run, "tid long, start long, settled boolean, gram long")


def shared_words(texts: DataFrame) -> DataFrame:
    """(tid, n_shared_words, n_passages) of the texts (tid, text), all different, that share a passage of WORDS words with another one."""
    two = F.min("tid") < F.max("tid")
    grams = word_anchor_rows(texts).groupBy("gram").agg(F.count("*").alias("times"), two.alias("two"))
    grams = written(grams.where("two").drop("two"), "word-grams")
    alive = written(of_grams(word_anchor_rows(texts), grams), "word-anchors")

    contexts = alive.groupBy("gram", "context").agg(F.count("*").alias("times"), two.alias("settled"), F.min(F.struct("tid", "start")).alias("first"))
    contexts = written(contexts, "word-contexts")
    per_gram = contexts.groupBy("gram").agg(F.count("*").alias("of"), (~F.every("settled")).alias("open"))
    contexts = written(join_counted(contexts, per_gram, ["gram"], "of").drop("of"), "word-contexts-open")
    alive = written(join_counted(alive, contexts, ["gram", "context"], "times").drop("gram", "context", "times"), "word-runs")

    wanted = alive.where(F.col("open") & (~F.col("settled") | (F.struct("tid", "start") == F.col("first"))))
    per_text = wanted.groupBy("tid").agg(F.collect_list(F.struct("start", "n", "settled")).alias("runs"))  # within one text
    per_text = written(per_text.select("tid", F.col("runs.start").alias("starts"), F.col("runs.n").alias("ns"), F.col("runs.settled").alias("settled")), "open-runs")
    windows = word_window_rows(texts.join(few(per_text.select("tid")), "tid", "left_semi").join(per_text, "tid"))
    windows = written(windows, "word-windows")
    shared = windows.groupBy("gram").agg(F.count("*").alias("times"), (two | F.some("settled")).alias("two"))
    found = of_grams(windows.where("not settled"), written(shared.where("two").drop("two"), "shared-windows"))

    runs = alive.where("settled").select("tid", "start", "n").unionByName(found.select("tid", "start", F.lit(1).alias("n")))
    runs = runs.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))
    later = F.expr("slice(runs, 2, size(runs))")  # one fewer: the last run's gap is null
    gaps = runs.select("tid", F.zip_with("runs", later, lambda a, b: F.struct(a["n"].alias("n"), (b["start"] - a["start"] - a["n"] + 1).alias("gap"))).alias("gaps"))
    words = F.aggregate("gaps", F.lit(0).cast("long"), lambda n, x: n + x["n"] - 1 + F.least(x["gap"], F.lit(WORDS)))
    passages = F.size(F.filter("gaps", lambda x: x["gap"].isNull() | (x["gap"] > WORDS))).cast("long")
    return gaps.select("tid", words.alias("n_shared_words"), passages.alias("n_passages"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (array of (a, b), maximal and in order), kept (binary), n_shared_words and n_passages of every text.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in this or another text.
    ``n_shared_words`` counts the words that lie in WORDS successive words which another row has too, whatever white
    space lies between them, removed or not; ``n_passages`` the maximal runs of such words.
    Null and empty texts keep nothing and lose nothing. Repeated rows and texts repeat each other and come out
    each; they are looked at once. Rows without doc_id take no part. Other columns are left out. An empty table stays empty.
    """
    docs = documents.where("doc_id is not null").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    short, long = docs.where(F.col("n_bytes") < WORDS_BYTES), docs.where(F.col("n_bytes") >= WORDS_BYTES).withColumn("same", F.unhex(F.md5("text")))
    texts = long.groupBy("same").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    passages = written(shared_words(texts.select("tid", "text")), "passages")
    spans = written(repeated_spans(texts.where(F.octet_length("text") >= LENGTH).select("tid", "text")), "spans")
    # A text that is there twice goes as a whole; of the others each has its spans in one row.
    per_text = spans.groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    @F.pandas_udf("removed array<struct<a:long,b:long>>, kept binary")
    def cut(texts: pd.Series, copies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, n, found in zip(texts, copies, spans, strict=True):
            data, merged = text.encode(), []
            found = [{"a": 0, "b": len(data)}] if n > 1 and len(data) >= LENGTH else [] if found is None else found
            for s in sorted((s["a"], s["b"]) for s in found):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            at, kept = 0, []
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            rows.append(([{"a": a, "b": b} for a, b in merged], b"".join([*kept, data[at:]])))
        return pd.DataFrame(rows, columns=["removed", "kept"])

    words = F.when(F.col("copies") > 1, F.regexp_count("text", F.lit(WORD))).cast("long")  # of a text that is there twice all are shared
    whole = F.when(F.col("copies") > 1, F.when(words >= WORDS, words).otherwise(0))
    counted = [F.coalesce(whole, "n_shared_words", F.lit(0)).alias("n_shared_words"), F.coalesce((whole > 0).cast("long"), "n_passages", F.lit(0)).alias("n_passages")]
    judged = texts.join(per_text, "tid", "left").join(passages, "tid", "left").select("same", "copies", cut("text", "copies", "spans").alias("cut"), *counted)
    judged = judged.select("same", "copies", "cut.*", "n_shared_words", "n_passages")
    done = join_counted(long.select("doc_id", "n_bytes", "same"), written(judged, "judged"), ["same"], "copies").drop("same", "copies")
    whole = short.select("doc_id", "n_bytes", F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)").alias("removed"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("kept"), *[F.lit(0).cast("long").alias(c) for c in ("n_shared_words", "n_passages")])
    out = done.unionByName(whole)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "removed", "kept", "n_shared_words", "n_passages")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words", "n_passages")
