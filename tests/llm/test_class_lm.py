import math
import random
import re
import zlib

import numpy as np
import pytest

from loomwatch.llm import class_lm


def corpus():
    r = random.Random(5)
    nouns, verbs, names = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)], [f"z{i}q" for i in range(300)]
    out = [(0, None, "x"), (1, "", "x"), (2, " \n", "x"), (3, "ONLY Once", "x"), (3, "ONLY Once", "x"), (None, "no id", "x"), (4, "É é\u00a0x", "x"), (5, "w " * 20_000, "x")]
    for i in range(10, 400):
        words = []
        for _ in range(r.randint(1, 40)):
            words += [r.choice(nouns), r.choice(verbs)]
            if r.random() < 0.1:
                words.append(r.choice(names))
        out.append((i, "\t".join(words), "x"))
    return out


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


@pytest.mark.parametrize("lexicon", [200_000, 50])
def test_base_scores_and_gain(spark, monkeypatch, lexicon):
    monkeypatch.setattr(class_lm, "LEXICON", lexicon)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = class_lm.score(df).collect()
    rows = [r for r in rows if r[0] is not None]
    assert len(got) == len(rows)
    counts = {}
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    texts = {i: tokens(t) for i, t, _ in rows}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["n_tokens"] == len(t) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in counts for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t), abs=1e-6)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in got)


def test_exchange_moves_items_but_not_the_end():
    rng = np.random.default_rng(2)
    classes = np.r_[rng.integers(0, 5, 300), 5]
    before = np.zeros((301, 6), np.int64)
    after = before.copy()
    before[:40, :5] = rng.integers(0, 9, (40, 5))
    after[:40, :5] = rng.permuted(before[:40, :5], axis=1)
    moved = class_lm.exchange(classes, before, after)
    assert moved[-1] == 5 and (moved[:-1] < 5).all() and (moved[100:] == classes[100:]).all()


def test_class_probabilities_sum_to_one():
    pairs = np.random.default_rng(3).integers(0, 50, (class_lm.CLASSES + 1,) * 2).astype(float)
    assert np.allclose((10 ** class_lm.model(pairs)).sum(1), 1)


@pytest.mark.parametrize("lexicon", [200_000, 40])
def test_words_that_are_not_exchanged_go_to_their_class(spark, monkeypatch, lexicon):
    """Nouns and verbs end alike, so that their shapes do not tell them apart, but their neighbours do."""
    monkeypatch.setattr(class_lm, "SINGLE", 20)
    monkeypatch.setattr(class_lm, "LEXICON", lexicon)
    df = spark.createDataFrame(corpus(), "doc_id long, text string, row string")
    score = lambda: sum(r["score"] for r in class_lm.score(df).where("held_out").collect())
    own = score()
    monkeypatch.setattr(class_lm, "likeliest", lambda counts, key, *_: counts.selectExpr(key, "0 as class").limit(0))
    assert own > score() + 100


def test_likeliest_class_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 9, (4, 4)).astype(float)
    steps, tokens = class_lm.model(pairs), pairs.sum(0)
    held = rng.integers(0, 5, (30, 8))
    rows = [(f"w{i}", s, int(n)) for i, x in enumerate(held) for s, n in enumerate(x) if n]
    got = {r["word"]: r["class"] for r in class_lm.likeliest(spark.createDataFrame(rows, "word string, slot int, n long"), "word", steps, tokens).collect()}
    for i, x in enumerate(held):
        fit = [sum(x[a] * steps[a, c] for a in range(4)) + sum(x[4 + b] * steps[c, b] for b in range(4)) - x[:4].sum() * math.log10(tokens[c] + 1) for c in range(3)]
        assert fit[got[f"w{i}"]] == pytest.approx(max(fit))


def test_without_training_text(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    got = class_lm.score(df).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)
    assert class_lm.score(df.limit(0)).count() == 0


def test_places_of_a_word_over_several_batches_by_brute_force(spark):
    """Rare words meet by word and go back by place; a word's places may lie in several batches."""
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 9, (4, 4)).astype(float)
    steps, tokens, of_code = class_lm.model(pairs), pairs.sum(0), np.array([0, 1, 2, 1, 3], np.uint8)
    rows = []
    for row in range(40):
        n = int(rng.integers(0, 6))
        words = [f"w{i}" for i in rng.integers(0, 7, n)]
        rows.append((row, row % 5 == 0, [*words, "held"] if row % 5 == 0 else words, list(range(n + (row % 5 == 0))), [int(a) << 32 | int(b) for a, b in rng.integers(0, 5, (n + (row % 5 == 0), 2))]))
    df = spark.createDataFrame(rows, "row long, held_out boolean, rare array<string>, at array<int>, beside array<long>")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        got = {(r["row"], r["at"]): (r["class"], r["c"], r["first"]) for r in class_lm.placed(df, of_code, steps, tokens).collect()}
    finally:
        spark.conf.set(size, own)
    places = {}
    for row, held, words, at, beside in rows:
        for w, i, b in zip(words, at, beside, strict=True):
            places.setdefault(w, []).append((row, i, held, of_code[b >> 32], of_code[b & 0xFFFFFFFF]))
    assert len(got) == sum(len(p) for w, p in places.items() if w != "held")
    for w, found in places.items():
        learnt = [p for p in found if not p[2]]
        fit = [sum(steps[p[3], c] + steps[c, p[4]] - math.log10(tokens[c] + 1) for p in learnt) for c in range(3)]
        mine = [got[p[:2]] for p in found if w != "held"]
        assert all(fit[c] == pytest.approx(max(fit)) and n == len(learnt) for c, n, _ in mine) and sum(f for *_, f in mine) == (w != "held")
