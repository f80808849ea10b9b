import random
import re

import numpy as np
import pytest
import xxhash

from loomwatch.llm import simhash
from loomwatch.llm.components import components


def plain_print(text, k=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and linked(a, b):
                    label[a], changed = label[b], True
    return label


TEXTS = [None, "", " \t", "one", "Two words", "ÀB c d", "a b c", "x " * 700, "x " * 699] + [
    " ".join(random.Random(i % 40).choices("the of and to in is was".split(), k=12)) + (" extra" if i >= 40 else "") for i in range(80)
]


def test_op7_against_brute_force(spark):
    rows = [(i, t, b"x") for i, t in enumerate(TEXTS)] + [(3, "one", b"x"), (None, "one", b"x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print binary")
    got = simhash.near_duplicates(df).collect()
    prints = {i: plain_print(t) for i, t in enumerate(TEXTS)}
    assert len(got) == len(TEXTS) + 1
    assert all(int.from_bytes(r["print"], "big") == prints[r["doc_id"]] for r in got)
    want = brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 20])
def test_links_within_radius(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = list({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(40)})
    nodes = spark.createDataFrame([(i, p.to_bytes(8, "big")) for i, p in enumerate(prints)], "node long, print binary")
    found = components(simhash.near_links(nodes, 3, simhash.block_choices(64, 3, 5)))
    got = {i: i for i in range(len(prints))} | {x["node"]: x["component"] for x in found.collect()}
    near = {(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3}
    label = list(range(len(prints)))
    for _ in range(50):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 46])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a, b = rng.integers(0, 2, (70, 256), np.uint8), rng.integers(0, 2, (130, 256), np.uint8)
    b[:60] = a[:60]
    for i in range(60):
        b[i, rng.choice(256, min(i, radius + 2), replace=False)] ^= 1
    want = (a[:, None, :] != b[None]).sum(2) <= radius
    assert (simhash.near(a, b, radius) == want).all()


def test_wide_prints_find_copies_and_leave_others(spark):
    r = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    docs = []
    for i in range(60):
        own = r.choices(words, k=300)
        docs.append((3 * i, " ".join(own)))
        own[150:152] = ["new", "pair"]
        own[20] = "other"
        docs.append((3 * i + 1, " ".join(own)))
        docs.append((3 * i + 2, " ".join(own[:150] + r.choices(words, k=150))))
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 46, 5, 4, None)
    label = {x["doc_id"]: x["component_id"] for x in got.collect()}
    assert sum(label[3 * i + 1] == 3 * i for i in range(60)) >= 58
    assert all(label[3 * i + 2] == 3 * i + 2 for i in range(60))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(900, 900), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)}
