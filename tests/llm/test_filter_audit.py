from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomwatch.llm import filter_audit
from loomwatch.llm.filter_audit import Trie, audit

DOCS = "doc_id long, text string, source string, part int, mask string, n double"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def result(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "m", 0.1) for r in rows], DOCS)
    df = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, n int"))
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def by_sql(rows, labels):
    con = duckdb.connect()
    con.register("d", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": "string", "source": "string"}))
    con.register("l", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic", "n"]).astype("Int64"))
    con.execute("create view documents as select doc_id, text, source from d; create view labels as select * from l")
    return Counter(con.execute(f"select {', '.join(COLUMNS)} from ({filter_audit.SQL})").fetchall())


def brute(rows, labels):
    """Filter by filter over the rows themselves."""
    fails = []
    for of, text, source in rows:
        text = text or ""
        words = text.encode().split()
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        f["E"] = of is not None and any(o is not None and o < of and (t or "") == text for o, t, _ in rows)
        fails.append((source or "", f, {c for c in ("good", "toxic") if any(x[0] == of and x[1 + (c == "toxic")] == 1 for x in labels if of is not None)}))
    out, shares = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, _, _ in fails}:
            left = [x for x in fails if x[0] == part]
            for k, f in enumerate(order):
                own = [x for x in fails if x[0] == part]
                gone, left = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                shares[part, f] += len(gone)
                failing = sum(x[1][f] for x in own)
                out[part, order, k + 1] = [len(left), len(gone), failing - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum("good" in x[2] for x in gone), sum("toxic" in x[2] for x in gone)]
    return Counter((*key, *v, shares[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def sample(seed, n=120):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(["a", "bb", "C", "#", "dé", "ee", "%x", "Q"] + [f"w{j}" for j in range(60)], rng.integers(0, 90))) for _ in range(25)]
    texts += [None, "", "   ", texts[0] + "x", texts[0][:-1]]
    rows = [(int(i), rng.choice(np.array(texts, object)), rng.choice(np.array(["s", "t", "", None], object))) for i in rng.permutation(n)]
    labels = [(int(i), int(q), int(t), 1) for i, q, t in zip(rng.permutation(n)[: n // 2], rng.integers(0, 2, n), rng.integers(0, 2, n))]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_and_sql(spark, seed):
    rows, labels = sample(seed)
    got = result(spark, rows, labels)
    assert got == brute(rows, labels) == by_sql(rows, labels)


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(None, "x", "s"), (None, "x", "s"), (1, "x", "s"), (1, "x", None), (2, "x", ""), (3, long, "s"), (4, long, "s"), (4, long, "s"), (5, None, "s"), (6, "", "s")]
    labels = [(2, 1, None, 1), (2, None, 1, 1), (None, 1, 1, 1), (4, 0, 0, 1), (4, 1, 0, 1)]
    assert result(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert result(spark, [], []) == Counter()
    rows, _ = sample(3, 20)
    assert result(spark, rows, []) == brute(rows, [])


def test_heavy_prefixes_are_told_apart_further_on(spark):
    rows = [(i, "same beginning " * (40 if i % 3 else 6) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = filter_audit.keyed(df, 5_000).collect()
    assert all(r["text"].startswith(r["key"]) for r in got) and len({r["key"] for r in got if r["doc_id"] % 3}) == 200
    assert {len(r["key"]) for r in filter_audit.keyed(df, 1 << 30).collect()} == {16}


def test_small_tasks_and_batches_give_the_same(spark, monkeypatch):
    rows, labels = sample(4, 200)
    monkeypatch.setattr(filter_audit, "TASK_BYTES", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(spark, rows, labels) == brute(rows, labels)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_holds_the_smallest_id_of_each_text():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice([97, 98, 200], rng.integers(0, 7)).astype(np.uint8)) for _ in range(2000)]
    trie, least, ids = Trie(), {}, rng.permutation(2000).tolist()
    nodes = [trie.insert(t, i) for i, t in zip(ids, texts)]
    for i, t in zip(ids, texts):
        least[t] = min(i, least.get(t, i))
    assert all(n.least == least[t] for n, t in zip(nodes, texts)) and len({id(n) for n in nodes}) == len(least)

    def walk(node, text):
        if node.least is not None:
            yield text
        for c in (node.children or {}).values():
            yield from walk(c, text + c.label)

    assert sorted(walk(trie, b"")) == sorted(least)
