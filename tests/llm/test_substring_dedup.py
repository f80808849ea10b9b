import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwatch.llm import substring_dedup as sd
from pyspark.sql import functions as F


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 3))
def test_suffix_array(s, times):
    s = s * times
    assert sd.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts):
    seen, n = {}, sd.LENGTH
    data = [(t or "").encode() for t in texts]
    for i, d in enumerate(data):
        for a in range(len(d) - n + 1):
            seen.setdefault(d[a : a + n], []).append((i, a))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i][a : a + n] = b"\x01" * n
    out = []
    for d, g in zip(data, gone, strict=True):
        kept = bytes(x for x, y in zip(d, g, strict=True) if not y)
        out.append((len(d), sum(g), sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared = [text(n) for n in (395, 399, 400, 401, 405, 450, 600, 1500)]
    texts = [None, "", "short", "x" * 3000, "ab" * 700, text(300)]
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(text(r.randint(0, 300)))
            piece = r.choice(shared)
            cut = r.randint(0, 40) if r.random() < 0.5 else 0
            parts.append(piece[cut:])
        texts.append("".join(parts))
    near = text(2500)
    for i in range(12):
        at = r.randint(0, 2499)
        texts.append(near[:at] + "#" + near[at + 1 :])
    return texts + [near, near]


@pytest.mark.parametrize("most", [500, 2])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(sd, "MOST", most)
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, gram int")
    got = sd.without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute(texts)


def test_repeated_rows_and_empty(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(900))
    df = spark.createDataFrame([(1, text), (1, text), (2, "z"), (None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in sd.without_repeats(df).collect()) == [(1, 900), (1, 900), (2, 0)]
    assert sd.without_repeats(df.limit(0)).count() == 0


def test_long_texts_in_segments(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    whole = [np.concatenate(c) for c in zip(*sd.anchors(data))]
    monkeypatch.setattr(sd, "SEGMENT", 700)
    starts = np.concatenate([np.arange(a, a + n) for s, n, *_ in sd.anchors(data) for a, n in zip(s, n)])
    assert starts.tolist() == list(range(len(data) - sd.LENGTH + 1)) and whole[1].sum() == len(starts)


def test_contexts_are_cut_to_what_windows_can_share():
    """Nothing is sorted that no other context of the part has next to the gram, and no shared window is lost."""
    r = random.Random(7)
    width = sd.LENGTH - sd.GRAM
    text = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    near_left, near_right = text(width), text(width)
    lefts, rights, parts = [], [], []
    for i in range(120):
        a, b = r.randint(0, width), r.randint(0, width)
        left, right = (text(width) + near_left[width - a :])[-r.randint(0, width) or width :], (near_right[:b] + text(width))[: r.randint(0, width)]
        if len(left) + len(right) >= width:
            lefts, rights, parts = [*lefts, left], [*rights, right], [*parts, i % 3]
    lefts, rights, parts = [*lefts, text(width)], [*rights, text(width)], [*parts, 0]
    seen = {}
    for i, (left, right, part) in enumerate(zip(lefts, rights, parts, strict=True)):
        for k in range(max(0, width - len(right)), len(left) + 1):
            seen.setdefault((part, left[len(left) - k :], right[: width - k]), []).append((i, len(left) - k))
    want = sorted(x for places in seen.values() if len(places) > 1 for x in places)
    some = sd.cut_to_shared(lefts, rights, parts)
    found = sd.sorted_repeats([lefts[i][len(lefts[i]) - a :] for i, a, _ in some], [rights[i][:b] for i, _, b in some], [parts[i] for i, *_ in some])
    assert want and sorted((i, at + len(lefts[i]) - a) for (i, a, _), places in zip(some, found, strict=True) for at in places) == want
    assert len(lefts) - 1 not in [i for i, *_ in some] and sum(a + b for _, a, b in some) < sum(map(len, lefts + rights))


def test_rows_of_repeated_grams_once_each(spark):
    rows = [(t, a, 1, 0, 7 if t % 2 else t, a) for t in range(40) for a in range(5)]
    df = spark.createDataFrame(rows, sd.ANCHOR)
    grams = df.groupBy("gram").agg(F.count("*").alias("times")).where("gram <> 4")
    for most in (0, 1, 1024):
        assert sorted(tuple(r) for r in sd.of_grams(df, grams, most, 8).collect()) == sorted(r for r in rows if r[4] != 4)


def brute_words(rows):
    """n_shared_words and n_passages of each (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), set()).add(i)
    out = []
    for w in words:
        shared = [False] * len(w)
        for k in range(len(w) - 50):
            if len(seen[tuple(w[k : k + 51])]) > 1:
                shared[k : k + 51] = [True] * 51
        out.append((sum(shared), sum(1 for k, x in enumerate(shared) if x and (k == 0 or not shared[k - 1]))))
    return out


def test_passages_of_over_fifty_words(spark):
    """Passages that are too short for LENGTH bytes stay, but are found in every document that shares them."""
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))
    passages = {n: text(n) for n in (50, 51, 52, 58, 70)}
    assert all(len(p.encode()) < sd.LENGTH for p in passages.values())
    texts = [None, "", " \n", "a" * 300, text(51), text(400), " ".join("a" * 120), " ".join("a" * 90)]
    for n, p in passages.items():
        texts += [f"{text(r.randint(0, 90))}\n{p} {text(r.randint(0, 90))}" for _ in range(3)]
        texts += [f"{text(70)} {p} {text(70)} {p}", f"{p} {passages[58]}", p.replace(" ", "\t\n")]
    once, short = text(60), passages[52]
    texts += [f"{once} {text(20)} {once}", short, short, text(50), texts[5], " ".join([text(30), texts[5].split(" ", 5)[5], text(9)])]
    rows = list(enumerate(texts))
    got = sorted(tuple(x) for x in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shared_words", "n_passages", "n_removed").collect())
    assert [x[1:3] for x in got] == brute_words(rows)
    assert [x[3] for x in got] == [b[1] for b in brute(texts)]
    planted = [i for i, t in rows if t and any(p in t for n, p in passages.items() if n > 50)]
    assert all(got[i][1] > 50 for i in planted) and sum(got[i][3] == 0 for i in planted) > 9


@pytest.mark.parametrize("segment", [90, 1 << 22])
def test_words_in_segments_and_groups(monkeypatch, segment):
    """Every window of every text has one anchor, the same wherever the text stands."""
    monkeypatch.setattr(sd, "SEGMENT", segment)
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(n)).encode() for n in (0, 60, 51, 50, 400, 1, 130)] + [b" \n", b"x" * 500]
    alone = {}
    for i, t in enumerate(texts):
        for _, starts, ns, grams, _ in sd.word_anchors([t]):
            alone |= {(i, k): g for s, n, g in zip(starts.tolist(), ns.tolist(), grams.tolist()) for k in range(s, s + n)}
    together = [((i, k), g) for found in sd.word_anchors(texts) for i, s, n, g, _ in zip(*[c.tolist() for c in found]) for k in range(s, s + n)]
    assert sorted(together) == sorted(alone.items())
    assert sorted(alone) == [(i, k) for i, t in enumerate(texts) for k in range(len(t.split()) - 50)]
