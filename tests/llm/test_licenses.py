import re

import numpy as np
import pytest

from loomwatch.llm import licenses
from loomwatch.llm.licenses import NOTICES, PHRASES, Template

SCHEMA = "doc_id long, text string, row string, label int, n_words string"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def scanned(spark, rows, **more):
    df = licenses.scan(spark.createDataFrame([(*r, "r", 1, "n") for r in rows], SCHEMA), ["doc_id"], **more)
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return [tuple(r) for r in df.collect()]


def brute(rows, phrases=PHRASES, notices=NOTICES):
    step = max(len(t.words) for t in (*phrases, *notices))
    out = []
    for of, text in rows:
        words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(i, p.label) for p in phrases for i in range(len(words)) if words[i : i + len(p.words)] == p.words]
        shares = {}
        for t in notices:
            for i in range(0, len(words), step):
                common = len(set(words[i : i + 2 * step]) & set(t.words))
                if common >= t.need:
                    shares[t.label] = max(shares.get(t.label, 0), common / t.size)
        base = {label for _, label in places}
        score = max([1.0] * bool(places) + list(shares.values()), default=0.0)
        out.append((of, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(shares))), score))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def held(spark, rows, **more):
    got = sorted(scanned(spark, rows, **more), key=key)
    assert got == sorted(brute(rows, **more), key=key)
    return got


def random_rows(seed, n=150):
    rng = np.random.default_rng(seed)
    common = ["the", "mit", "license", "general", "public", "apache", "under", "of", "und", "é", "4", "0", "cc", "by", "nc", "software", "this", "is"]
    rows = []
    for i in range(n):
        words = list(rng.choice(common, rng.integers(0, 200)))
        if i % 3 == 0:
            words[10:10] = rng.choice(NOTICES).text.upper().split()
        if i % 5 == 0:
            words += ["MIT", "License"]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    assert len({r[6] for r in held(spark, random_rows(seed))}) > 3


def test_phrases_across_blocks(spark):
    step = max(len(t.words) for t in (*PHRASES, *NOTICES))
    rows = [(at, "w " * at + "general public license " + "w " * (3 * step)) for at in range(step - 4, 2 * step + 2)]
    assert all(r[2] == 1 and r[3] == r[4] == r[0] for r in held(spark, rows))


def test_odd_rows(spark):
    rows = [(None, "MIT License"), (1, None), (2, ""), (3, " \n"), (4, "apache license " * 20_000), (4, "mit license"), (4, "mit license"), (5, "mit der license"), (6, "Mit-License, übermit license"), (7, "Licensed under CC BY-NC 4.0.")]
    got = {r[0]: r for r in held(spark, rows)}
    assert got[4] and got[7][6] == "cc-by-nc-4.0" and got[5][5] == ""


def test_empty_table(spark):
    assert scanned(spark, []) == []


def test_large_lists_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST", 0)
    held(spark, random_rows(5, 30))


def test_partial_containment(spark):
    some = (Template("t", "one two three four five", 0.8),)
    got = held(spark, [(1, "five four three two"), (2, "one two three"), (3, "x one y two z three w five five")], phrases=PHRASES[:1], notices=some)
    assert [r[7] for r in got] == [0.8, 0.0, 0.8]


def test_the_prefix_has_the_rarest_words():
    rank = {w: i for i, w in enumerate(["nc", "cc", "licensed", "under", "by", "4", "0"])}
    t = Template("x", "licensed under cc by-nc 4.0", 0.8)
    assert t.size == 7 and t.need == 6 and licenses.prefix(t, rank) == [0, 1]
