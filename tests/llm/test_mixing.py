import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwatch.llm import mixing


def reshared(sizes, weights):
    """Targets by resharing step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, itertools.cycle(weights)))
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else share[s] for s in names}
        full |= over


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 400))
def test_fit_is_the_best_sum(counts, budget):
    sizes, n = np.array(list(counts)), np.array(list(counts.values()))
    taken = mixing.fit(sizes, n, budget)
    assert (taken >= 0).all() and (taken <= n).all()
    if budget >= (sizes * n).sum():
        assert (taken == n).all()
        return
    base = n * budget // (sizes * n).sum()
    sums = {0}
    for s, m in zip(sizes, n - base):
        sums = {x + s * k for x in sums for k in range(m + 1)}
    left = budget - int((base * sizes).sum())
    assert (taken * sizes).sum() - (base * sizes).sum() == max(x for x in sums if x <= left)


def test_large_budgets_come_near():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 3000)
    n = rng.integers(1, 50, len(sizes))
    for share in (0.1, 0.5, 0.99):
        budget = int((sizes * n).sum() * share)
        taken = mixing.fit(sizes, n, budget)
        assert (taken * sizes).sum() == budget and (taken <= n).all()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    sources = ["b", "a", "Z", "é", None, "tiny", ""]
    out = []
    for i in range(900):
        s = sources[int(rng.choice(7, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.01, 0.04]))]
        out.append((i, "\x0b".join(["w"] * int(rng.integers(0, 60))) or None, s))
    return out + [(5, "twin text", "a"), (5, "twin text", "a"), (None, "no id", "b"), (901, " \t ", "b")]


def test_mix(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, rank int, base int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want, taken = reshared(sizes, (5, 2, 1)), {}
    for r in got:
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3 and (r["size"] or not r["copies"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 + 0.01 * t
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).select("doc_id", "text", "copies").fillna(-1).fillna("").collect())) == sorted(map(tuple, mixing.mix(df).select("doc_id", "text", "copies").fillna(-1).fillna("").collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r["copies"] for r in mixing.mix(df.where("text is null")).collect()} == {0}


def test_ranks_do_not_gather_a_key(spark):
    from loomwatch.llm.common import ranked

    df = spark.createDataFrame([(i % 2 if i % 5 else None, i // 2) for i in range(400)], "k int, v int")
    got = ranked(df, ["k"], ["v"]).collect()
    for k in (0, 1, None):
        assert sorted(r["rank"] for r in got if r["k"] == k) == list(range(sum(r["k"] == k for r in got)))


def best(sizes, counts, budget):
    sums = {0}
    for s, n in zip(sizes, counts):
        sums = {x + k * s for x in sums for k in range(n + 1) if x + k * s <= budget}
    return max(sums)


@pytest.mark.parametrize(
    ("sizes", "counts", "budget"),
    [
        ([150_000, 140_000, 139_000, 20], [1, 1, 1, 100], 280_000), ([900_000, 500_000, 499_000], [1, 1, 1], 1_000_000), ([200_000], [3], 399_999), ([300_000, 7], [1, 2], 299_999),
        ([700_001, 400_003, 300_007, 299_993, 131_101], [1, 2, 1, 2, 1], 1_300_000), ([10_000_000, 6_000_000, 4_000_000, 1], [1, 1, 1, 10], 10_000_010),
    ],
)
def test_few_very_long_documents(sizes, counts, budget):
    sizes, counts = np.array(sizes), np.array(counts)
    taken = mixing.fit(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    got, most = int((taken * sizes).sum()), best(sizes.tolist(), counts.tolist(), budget)
    assert got <= budget and got >= 0.99 * most


def test_many_lengths_past_the_program(monkeypatch):
    monkeypatch.setattr(mixing, "RESERVE", 64)
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 900, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(1, (sizes * counts).sum() + 1))
        taken = mixing.fit(sizes, counts, budget)
        got, most = int((taken * sizes).sum()), best(sizes.tolist(), counts.tolist(), budget)
        assert (taken >= 0).all() and (taken <= counts).all() and got <= budget and got >= most - max(0.1 * most, 30)
