import random

import numpy as np
import pandas as pd
import pytest

from loomwatch.llm import simhash, similar

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(r, bases=60):
    """Texts of 40 to 200 words; each with copies in which runs of words are changed, from nearly alike to well apart."""
    texts = []
    for _ in range(bases):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(40, 200))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy, share = list(base), r.uniform(0.01, 0.2)
            at = r.randrange(len(base))
            for i in range(at, min(len(base), at + int(share * len(base)))):
                copy[i] = f"x{r.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


def brute(texts):
    sets = [set(zip(*[t.lower().split()[i:] for i in range(5)], strict=False)) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if label[b] < label[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize(("hot", "tile"), [(20_000, 512), (8, 16)])
def test_groups_are_those_of_the_shingles(spark, monkeypatch, hot, tile):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(similar, "TILE", tile)
    texts = corpus(random.Random(3))
    got = similar.groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()
    want = brute(texts)
    assert len(set(want)) > 70 and len(set(want)) < len(texts) - 100
    assert {r["row"]: r["component"] for r in got} == dict(enumerate(want))


def test_odd_texts(spark):
    rows = list(enumerate([None, "", " \t", "one", "ONE", "one two three four five six", "One two three\tfour five six", "é"]))
    df = spark.createDataFrame(rows, "row long, text string")
    assert {r["row"]: r["component"] for r in similar.groups(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert similar.groups(df.limit(0)).count() == 0


def test_stage_drops_what_the_shingles_say(spark):
    texts = corpus(random.Random(5))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.stage_near_dedup(spark, docs, "").collect()}
    assert kept == set(brute(texts))


def test_stage_tells_rows_apart_without_ids(spark):
    r = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{r.randrange(5000)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, c, "x"), (1, a, "x"), (7, c, "x"), (7, d, "x"), (7, d, "x"), (8, d + " more", "x"), (2, c, "y"), (9, e, "x"), (9, e, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, corpus_pipeline.stage_near_dedup(spark, docs.repartition(n), "").collect()), key=str) for n in (1, 3))
    assert first == again
    assert [x for x in first if x[0] is None] == sorted([(None, a, "x"), (None, b, "x"), (None, c, "x")])
    assert [(i, t) for i, t, _ in first if i is not None] == [(1, a), (2, c), (7, d), (9, e)]


def test_tile_gives_fewer_links_than_rows_and_counts_pairs_once():
    texts = corpus(random.Random(11), 12)
    signed = [similar.signature(t) for t in texts]
    rows = pd.DataFrame({"group": 1, "at": 0, "part": 0, "alone": True, "label": range(len(texts)), "print": [s[1] for s in signed]})
    rows["keys"], rows["hashes"] = [s[2] for s in signed], [similar.hashed(t).tobytes() for t in texts]
    links = similar.tile_links(rows)
    label = list(range(len(texts)))
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    assert label == brute(texts) and len(links) == len(texts) - len(set(label))
    # later keys leave a pair to the first key that both rows have; two parts leave a pair within one to its own meeting
    common = np.array([1, 2, 3], np.int64)
    assert similar.tile_links(rows.assign(at=2, keys=[common] * len(rows))) == []
    assert similar.tile_links(rows.assign(alone=False)) == []
    # groups that share a tile stay apart
    assert similar.tile_links(rows.assign(group=range(len(rows)))) == []
