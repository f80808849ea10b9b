import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwatch.llm import quality


def brute(texts, alphabet):
    """Interpolated modified Kneser-Ney over symbols, straight from the definition."""
    n, size = quality.ORDER, quality.ALPHABET
    counts = {n: Counter(tuple(g) for t in texts for g in np.lib.stride_tricks.sliding_window_view(quality.symbols(t, alphabet), n).tolist())}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        m = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] + m[1] else 0
        discounts[k] = [max(quality.LEAST_DISCOUNT, i - (i + 1) * y * m[i] / m[i - 1]) if m[i - 1] else quality.LEAST_DISCOUNT for i in (1, 2, 3)]
        for g, v in c.items():
            contexts[k][g[:-1]].append(v)

    def p(g):
        k = len(g)
        if not k:
            return 1 / size
        seen = contexts[k].get(g[:-1])
        below = p(g[1:])
        if not seen:
            return below
        cut = lambda v: min(v, discounts[k][min(v, 3) - 1]) if v else 0
        v = counts[k].get(g, 0)
        return (v - cut(v)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * below

    return lambda t: 2 ** -np.mean([math.log2(p(tuple(g))) for g in np.lib.stride_tricks.sliding_window_view(quality.symbols(t, alphabet), n).tolist()])


def sentence(r, n):
    return " ".join(r.choice(["the", "of", "thing", "stone", "river", "and"]) for _ in range(n)) + "."


def test_perplexity_against_the_definition(spark):
    r = random.Random(1)
    texts = [sentence(r, r.randint(1, 12)) for _ in range(30)]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = brute(texts, model.alphabet)
    for t in ["the river", "zzz", "é", "STONE!", texts[0], "x" * 500]:
        assert model.perplexity(t) == pytest.approx(want(t), rel=1e-4)
    assert model.perplexity("") is None and model.perplexity(None) is None
    table = 2.0 ** -model.table().astype(float).reshape(-1, quality.ALPHABET)
    assert np.allclose(table.sum(1)[:: 997], 1, atol=1e-4)


def test_junk_goes_and_clean_text_stays(spark):
    r = random.Random(2)
    docs = [(i, sentence(r, r.randint(30, 90)), "en" if i % 3 else None) for i in range(600)]
    junk = [(600 + i, " ".join(w.upper() + "!!#" for w in sentence(r, 40).split()), "en") for i in range(60)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "x", "xx"), (None, docs[0][1], "en"), (1, docs[1][1], "en")]
    df = spark.createDataFrame([(*d, "c") for d in docs + junk + odd], "doc_id long, text string, lang string, threshold string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 2)] + [(i, 0, 0) for i in range(600, 660)] + [(3, 1, 1), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(docs) + len(junk) + len(odd)
    keep = {(x["doc_id"], x["lang"]): x["keep"] for x in got}
    assert np.mean([keep[d[0], d[2]] for d in docs]) > 0.97 and not any(keep[d[0], "en"] for d in junk) and not keep[900, "en"] and not keep[901, "en"]
    assert quality.classify(df.limit(0), labels).count() == 0
    assert all(x["keep"] == bool(x["text"]) and x["threshold"] is None for x in quality.classify(df, labels.limit(0)).collect())


def test_quantiles_are_of_all_trusted_documents(spark, monkeypatch):
    """A language that has no document among the few that the model is fitted on still has its own threshold."""
    monkeypatch.setattr(quality, "SAMPLE", 5)
    r = random.Random(4)
    docs = [(i, sentence(r, 40) if i % 4 else sentence(r, 40).upper(), "en" if i % 4 else "xx") for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = quality.classify(df, spark.createDataFrame([(i, 1, 0) for i in range(800)], "doc_id long, quality int, toxic int")).collect()
    assert len({x["threshold"] for x in got}) == 2
    for lang in ("en", "xx"):
        assert 0.98 <= np.mean([x["keep"] for x in got if x["lang"] == lang]) <= 1


def test_other_scripts_are_told_apart():
    alphabet = np.array(sorted(map(ord, "abc")), np.uint32)
    found = {tuple(quality.symbols(t, alphabet).tolist()) for t in ("\u0434", "\u05d0", "\u4e2d")}
    assert len(found) == 3


def test_the_model_is_fitted_on_a_whole_half(spark, monkeypatch):
    """However many trusted documents there are, none of the half is left out; the other half sets the thresholds."""
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda texts: (seen.append(texts.count()), train(texts))[1])
    df = spark.range(25_000).selectExpr("id as doc_id", "concat('text ', id % 7) as text", "'en' as lang")
    labels = df.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert quality.classify(df, labels).where("keep").count() > 24_000
    assert seen == [labels.where("pmod(xxhash64(doc_id, 23), 2) = 0").count()] and seen[0] > 12_000


def many_scripts(r, n):
    """Texts of several hundred characters, few of them frequent, some outside the basic plane."""
    rare = [chr(c) for c in (*range(0x410, 0x450), *range(0x5D0, 0x5EA), *range(0x4E00, 0x4E80), *range(0x1F600, 0x1F620))]
    return ["".join(r.choice(rare) if r.random() < 0.2 else r.choice("etaoin shrdlu") for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("held", [quality.HELD, 100])
def test_every_character_is_a_symbol(spark, monkeypatch, held):
    """Perplexities over more characters than the dense table has symbols are those of the definition, whether the model is held or joined."""
    monkeypatch.setattr(quality, "HELD", held)
    r = random.Random(5)
    texts = many_scripts(r, 60)
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert set(model.alphabet.tolist()) == {ord(c) for t in texts for c in t} | {10} and len(model.alphabet) > quality.ALPHABET
    asked = [*many_scripts(r, 20), texts[0], texts[0], "\u0434", "plain", "\u0e01 lacks", "", None]
    got = {x["text"]: x["x"] for x in quality.with_perplexity(spark.createDataFrame([(t,) for t in asked], "text string"), model, "x").collect()}
    monkeypatch.setattr(quality, "ALPHABET", model.size)
    want = brute(texts, model.alphabet)
    assert (model.tables is not None) == (held == 100)
    for t in asked:
        assert got[t] == (pytest.approx(want(t), rel=1e-4) if t else None)


def test_rare_letters_in_disorder_are_found(spark):
    """Letters beyond the most frequent ones are told apart: words of them in the trusted order stay likelier than the same letters shuffled."""
    r = random.Random(6)
    words = ["".join(map(chr, range(0x410 + 8 * k, 0x418 + 8 * k))) for k in range(8)]
    texts = [sentence(r, 40) + "".join(f" {c}" for c in map(chr, range(33, 127))) * 3 + " " + " ".join(r.choice(words) for _ in range(3)) for _ in range(60)]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    ordered = " ".join(words)
    shuffled = " ".join("".join(r.sample(w, len(w))) for w in words)
    assert model.perplexity(shuffled) > 2 * model.perplexity(ordered)
