import zlib
from collections import Counter
import re

import numpy as np
import pandas as pd
import pytest

from loomwatch.llm import spelling

SCHEMA = "doc_id long, text string, word int, n string, form double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=7):
    n = Counter()
    for of, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if of is None else of}:{run}".encode())
            p = h % len(run)
            n[run[:p] + run[p + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= 2}
    beside = {w: sorted((v for v in n if is_near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: b[0] if b and n[b[0]] >= 10 * n[w] else None for w, b in beside.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def held(spark, rows):
    got = rows_of(spelling.variants(docs(spark, rows)))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    return set(got)


def random_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcé"), rng.integers(7, 10))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for w in rng.choice(base, 12):
            k, p = rng.integers(0, 12), rng.integers(0, len(w))
            words.append({0: w[:p] + w[p + 1 :], 1: w[:p] + "b" + w[p:], 2: w[:p] + "É" + w[p + 1 :]}.get(k, w))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    assert any(r[1] for r in held(spark, random_rows(seed)))


def test_a_key_of_many_words_is_dealt_in_parts(spark, monkeypatch):
    want = held(spark, random_rows(3))
    monkeypatch.setattr(spelling, "HOT", 6)
    monkeypatch.setattr(spelling, "BLOCK", 4)
    assert held(spark, random_rows(3)) == want


def test_forms_lead_to_a_root_and_ties_go_by_code_point(spark):
    counts = {"aaaaaaa": 2000, "aaaaaab": 200, "aaaaabb": 20, "aaaabbb": 2, "zzzzzzza": 40, "zzzzzzzb": 40, "zzzzzzzc": 4}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    got = {r[0]: r for r in held(spark, [(1000 + i, t) for i, t in rows])}
    assert len(got) >= 7 and {r[2] for w, r in got.items() if w.startswith("aaaa")} >= {"aaaaaaa"}


def test_odd_rows(spark):
    long = "x" * 20_000
    rows = [(None, "Straßen straßen STRASSEN"), (1, None), (2, ""), (3, f"{long} {long}y {long}"), (3, f"{long} {long}y {long}"), (4, "kurz  ×÷×÷×÷× ×÷×÷×÷×"), (5, "ÄPFELCHEN äpfelchen")]
    held(spark, rows)


def test_empty_table(spark):
    assert rows_of(spelling.variants(docs(spark, []))) == []


def test_short_words_have_keys_where_a_segment_is_empty(spark):
    words = spark.createDataFrame([("", 5), ("a", 3), ("b", 1), ("ab", 2), ("ba", 2), ("abc", 1)], "word string, n long")
    got = {r["word"]: r["n_near"] for r in spelling.near_words(words).collect()}
    assert got == {"": 2, "a": 4, "b": 4, "ab": 3, "ba": 2, "abc": 1}


def test_matrices_and_prefixes():
    words = np.array(["abcx", "abx", ""])
    forward, backward, sizes = spelling.matrices(words)
    assert sizes.tolist() == [4, 3, 0] and (backward[0] == forward[0][::-1]).all()
    assert spelling.near(forward[:1], forward[1:2])[0, 0] == 2 and spelling.near(backward[:1], backward[1:2])[0, 0] == 1


def test_cuts_keep_groups_whole():
    groups = np.repeat(np.arange(60), np.random.default_rng(1).integers(1, 40, 60))
    rows = pd.DataFrame({"group": groups, "i": range(len(groups))})
    found = list(spelling.cuts(rows.iloc[a : a + 37] for a in range(0, len(rows), 37)))
    of = [set(f["group"]) for f in found]
    assert sum(len(s) for s in of) == len(set().union(*of)) == (rows.groupby("group").size() > 1).sum()
