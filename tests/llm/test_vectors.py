import numpy as np
import pytest

from loomwatch.llm import embedding_dedup, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def rows(n=400, d=16, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, d))
    out = []
    for i in range(n):
        v = base[i % len(base)] + rng.standard_normal(d) * rng.choice([0.0, 0.03, 0.09, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(i % len(base)) % labels, 1))
    out += [(1000, None, 1, 1), (1001, [], 1, 1), (1002, [0.0] * d, 1, 1), (1003, [float("nan")] * d, 1, 1), (1004, [None] * d, 1, 1), (1005, [float("inf")] + [1.0] * (d - 1), 1, 1), (1006, out[0][1], None, 1), (1100, [1.0, 2.0], 1, 1), (1200, [2.0, 4.0], 1, 1), (None, out[0][1], 0, 1)]
    return out


def good(r):
    return r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])


@pytest.mark.parametrize(("shard", "widest", "recall"), [(8192, 256, 0.99), (40, 256, 0.99), (40, 16, 2.0)])
def test_embedding_dedup(spark, monkeypatch, shard, widest, recall):
    """A recall beyond 1 fails every audit, so that all links are found."""
    monkeypatch.setattr(embedding_dedup, "RECALL", recall)
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "PART", shard)
    monkeypatch.setattr(embedding_dedup, "WIDEST", widest)
    data = rows()
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert len(got) == len(data) - 1
    links = {r[0]: set() for r in data if r[0] is not None}
    usable = [r for r in data if good(r) and r[2] is not None]
    for a in usable:
        for b in usable:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]].add(b[0])
    label = {i: i for i in links}
    for _ in range(30):
        for a, bs in links.items():
            for b in bs:
                label[a] = label[b] = min(label[a], label[b])
    assert sum(got[i]["n_links"] for i in links) >= (0.97 if recall < 1 else 1) * sum(map(len, links.values()))
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert sum(got[i]["component_id"] == label[i] for i in links) >= 0.98 * len(links)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_empty_and_all_unusable(spark):
    df = spark.createDataFrame(rows()[-10:-4], SCHEMA)
    assert [r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()] == [0] * 6
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert neighbours.search(df, df.withColumnRenamed("vec_id", "query_id")).count() == 0


@pytest.mark.parametrize(("chunk", "block"), [(4096, 4096), (64, 8)])
def test_neighbours(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    data = rows() + [(5, rows()[5][1], 2, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    usable = {r[0]: np.array(r[1], float) for r in data if good(r)}
    found = total = 0
    for q in [i for i in usable if i % 20 == 0]:
        want = sorted((float(np.sqrt(np.cumsum((usable[q] - v) ** 2)[-1])), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:10]
        assert len(got.get(q, [])) == len(want)
        found, total = found + len({i for _, i in want} & {i for _, i in got.get(q, [])}), total + len(want)
    assert found >= 0.99 * total


def test_ties_go_to_the_smaller_id(spark):
    data = [(i, [float(i % 3), 1.0], 1, 1) for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA)
    got = neighbours.search(df, df.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), k=12).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.0) for i in range(3, 30, 3)] + [(i, 1.0) for i in (1, 4, 7)]


def test_few_are_reranked(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in v], 1, 1) for i, v in enumerate(rng.standard_normal((3000, 64)))]
    df = spark.createDataFrame(data, SCHEMA)
    found = neighbours.reranked(df, df.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10).groupBy().sum("reranked").first()[0]
    assert found < 0.3 * 30 * 3000


def test_audit_of_others_and_failed():
    rng = np.random.default_rng(4)
    unit = lambda x: (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    held = unit(rng.standard_normal((600, 8)))
    asked = unit(held[:50] + 0.01 * rng.standard_normal((50, 8)))
    graph = embedding_dedup.Graph(held)
    width, share = embedding_dedup.audited(graph, np.arange(600), np.arange(1000, 1050), asked, 0.98)
    assert share >= 0.99 and width <= embedding_dedup.WIDEST
    graph.near = [[[] for _ in levels] for levels in graph.near]  # no beam gets anywhere
    width, share = embedding_dedup.audited(graph, np.arange(600), np.arange(1000, 1050), asked, 0.98)
    assert width > embedding_dedup.WIDEST and len(graph.above(asked[0], 0.98, width)) == (held @ asked[0] >= 0.98).sum()
