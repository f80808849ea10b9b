import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwatch.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


TEXTS = ["", "one", "a  b", " lead", "trail ", "tab\tx  y\n z", "a \n b", "don't stop", "ünï cödé ", "x<|endoftext|>y", "a  b", "word " * 3000, None, "one", "\x00 z", "1 2  3", "a. B\nC d"]


def test_ids_are_the_tokenizers(tokenizer):
    encode = packing.Encoder(packing.tokenizer_path())
    for t in TEXTS:
        assert encode(t or "") == tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'\u00a0\u2003\x1c\x85stde1²Ⅷ中é́\u200d😀"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40))
def test_ids_of_odd_characters(text):
    e = packing.encoder(packing.tokenizer_path())
    assert e(text) == e.load().encode(text, add_special_tokens=False).ids


def test_pack_round_trip(spark, tokenizer):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, "one", "x", 1), (None, "no id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int")
    got = packing.pack(df, packing.tokenizer_path(), size=256).toPandas()
    assert got["doc_id"].notna().all()
    once = got[got["doc_id"] != 1]
    for i, t in enumerate(TEXTS):
        if i == 1:
            continue
        part = once[once["doc_id"] == i].sort_values("start")
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.concatenate([np.frombuffer(b, "<u4") for b in part["ids"]]).tolist() == want
        assert part["start"].tolist() == np.r_[0, part["length"].cumsum()][:-1].tolist()
        assert (part["doc_tokens"] == len(want)).all()
    assert (got["doc_id"] == 1).sum() >= 2
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.r_[0, s["length"].cumsum()][:-1].tolist() and s["length"].sum() <= 256
    used = got.groupby("sequence_id")["length"].sum()
    assert (used == 256).mean() > 0.9
    assert zlib.crc32(b"") == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_token_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, rng.integers(1, 400)) if seed else np.full(37, 41)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    seen, sequences = {}, {}
    for length, lo, hi, start, n, sequence, offset in packing.plan(histogram, 64, 2):
        for rank in range(lo, hi):
            seen.setdefault((length, rank), []).append((start, n))
            sequences.setdefault(sequence + rank - lo, []).append((offset, n))
    assert len(seen) == len(lengths)
    for (length, rank), parts in seen.items():
        assert rank < histogram[length]
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == length
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
        total += at
    assert total == lengths.sum()
    short = [sum(n for _, n in p) for p in sequences.values()]
    assert sum(64 - x for x in short if x & (x - 1)) <= 64 + 2 * len(short)
