import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(r, n):
    return " ".join(r.choice(["river", "stone", "the", "of", "and", "light", "tower", "glass", "wind"]) for _ in range(n))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r = random.Random(7)
    docs = [(i, words(r, r.randint(60, 200)), "en", "src%d" % (i % 4)) for i in range(200)]
    docs += [(1000 + i, docs[i][1], "en", "src0") for i in range(20)]
    docs += [(2000 + i, docs[i][1] + " wind", "en", "src1") for i in range(20, 40)]
    docs += [(3000 + i, docs[50 + i][1].upper().replace(" ", "!!## "), "en", "src1") for i in range(20)]
    docs += [(4000 + i, words(r, 80) + ' token = "%s"' % r.randbytes(20).hex(), "en", "src2") for i in range(20)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.written(stage(spark, docs, data), "test")
        assert docs.columns == columns
        kept[name] = docs.collect()
    quality, unique, clean, mixed = ([r["doc_id"] for r in kept[n]] for n, _ in corpus_pipeline.STAGES[:-1])
    assert sum(i < 200 for i in quality) >= 190 and not any(3000 <= i < 3020 for i in quality)
    assert len(unique) == len(set(unique)) and not any(1000 <= i < 1020 and i - 1000 in quality for i in unique)
    assert sum(i < 200 for i in unique) >= 180 and sum(2000 <= i < 3000 for i in unique) <= 2
    assert sorted(clean) == sorted(unique)
    assert not any('token = "' in r["text"] for r in kept["secret_scan"])
    assert set(mixed) <= set(clean) and max(mixed.count(i) for i in set(mixed)) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    whole = packed.groupby("doc_id")["length"].sum()
    first = packed.drop_duplicates("doc_id").set_index("doc_id")["doc_tokens"]
    assert all(whole[i] == first[i] * mixed.count(i) for i in set(mixed))


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, copies int, keep boolean, perplexity double, spans string, component long, row int"


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and texts, ids that repeat; columns with names that stages use."""
    r = random.Random(3)
    own = (-1, 9, True, 0.5, "s", 7, 8)
    long = words(r, 60_000)
    texts = [words(r, 80) for _ in range(8)]
    rows = [(1, texts[0], "en", "a"), (1, texts[0], "en", "a"), (None, texts[1], "en", "a"), (None, texts[2], "en", "b"), (7, texts[3], "en", "b"), (7, texts[4], "en", None), (8, texts[5], None, "b"), (9, None, "en", "a"), (10, "", "en", "a"), (11, "  ", "en", "a"), (12, long, "en", "a"), (13, texts[6], "en", "a"), (14, texts[6], "en", "b"), (None, None, None, None)]
    return [(*x, len(x[1]) if x[1] else None, *own) for x in rows], own


@pytest.mark.parametrize("name", ["quality_classifier", "simhash_near_dedup", "secret_scan", "mixing"])
def test_stages_on_odd_rows(spark, data, name):
    rows, own = odd_rows()
    df = spark.createDataFrame(rows, ODD)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, df, data)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert all(r[5:] == own for r in got)
    ids = sorted((r[0] is None, r[0] or 0) for r in got)
    if name == "secret_scan":
        assert sorted(map(repr, got)) == sorted(map(repr, rows))
    elif name == "quality_classifier":
        assert set(got) <= set(rows) and not any(r[1] in (None, "") for r in got)
    elif name == "mixing":
        assert set(got) <= set(rows) and all(r[1] and r[1].strip() for r in got)
    else:  # one of each text; rows without id stay
        assert [i for n, i in ids if not n] == [1, 7, 7, 8, 9, 12, 13] and sum(n for n, _ in ids) == 3
    assert stage(spark, df.limit(0), data).count() == 0


def test_packing_of_odd_rows(spark, data):
    rows, _ = odd_rows()
    df = spark.createDataFrame(rows, ODD)
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, df, data)
    assert packed.where("doc_id = 12").count() > 20
    assert dict(corpus_pipeline.STAGES)["packing"](spark, df.limit(0), data).count() == 0
