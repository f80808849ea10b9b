"""License scans as an exact set-similarity join of text blocks with templates.

A block is a window of twice as many words as the longest template has, a new one beginning at each half, so
that whatever a template's length covers lies within one. Words of templates are ranked by how often the whole
corpus uses them, rarest first. A template is contained in a block if enough of its distinct words are there;
then the rarest common one is among the template's first few (its prefix), so blocks are joined with templates
by prefix words only. The block's number of words and what can still follow the common word on both sides rule out
most pairs before whole sets are compared. Phrases, which must stand as they are, are templates contained
in full whose places are looked at afterwards.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwatch.llm.common import table, written

#: Of UTF-8: letters and digits of ASCII (A-Z lower-cased before) and all beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Entries of the templates' index up to which it is broadcast.
BROADCAST = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Share of its distinct words that a block must hold.
    least: float = 1.0
    #: The words must stand one after another.
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return [w.decode() for w in WORDS.findall(self.text.encode().lower())]

    @property
    def size(self) -> int:
        return len(set(self.words))

    @property
    def need(self) -> int:
        return max(1, math.ceil(self.least * self.size - 1e-9))


# Phrases of the contract, then notices that common licenses ask for or begin with.
PHRASES = (
    Template("mit", "mit license", phrase=True),
    Template("apache", "apache license", phrase=True),
    Template("gpl", "general public license", phrase=True),
)
NOTICES = (
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2.0"),
    Template("as-is", "the software is provided as is without warranty of any kind express or implied", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4.0 international license"),
    Template("cc-by-nc-4.0", "licensed under cc by-nc 4.0"),
    Template("cc-by-sa-4.0", "licensed under cc by-sa 4.0"),
    Template("cc0-1.0", "cc0 1.0 universal public domain dedication", 0.8),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", 0.8),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", 0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8),
)


def ranks(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The templates' words by how often all documents use them, rarest first; as many as the templates have."""
    known = {w.encode() for w in vocabulary}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                n.update(filter(known.__contains__, WORDS.findall(text.encode().lower())))
        yield pd.DataFrame({"word": [w.decode() for w in n], "n": list(n.values())}).astype({"word": str, "n": "int64"})

    found = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "word string, n long")
    counts = dict(found.groupBy("word").agg(F.sum("n")).collect())
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def prefix(template: Template, rank: dict[str, int]) -> list[int]:
    """One of these is in every block that contains enough of the template."""
    return sorted(rank[w] for w in set(template.words))[: template.size - template.need + 1]


def blocks(documents: DataFrame, keys: list[str], templates: tuple[Template, ...], rank: dict[str, int], step: int) -> DataFrame:
    """The keys of every row with n_words and blocks (first, at, tokens): places and ranks of the templates' words in the blocks that hold a word of some prefix."""
    known = {w.encode(): r for w, r in rank.items()}
    leading = {r for t in templates for r in prefix(t, rank)}

    def of(text: str) -> tuple[int, list[dict]]:
        words = WORDS.findall(text.encode().lower())
        hits = [(i, known[w]) for i, w in enumerate(words) if w in known]
        starts = sorted({k for i, r in hits if r in leading for k in (i // step, i // step - 1) if k >= 0})
        out, at = [], [i for i, _ in hits]
        for k in starts:
            held = slice(bisect_left(at, k * step), bisect_left(at, (k + 2) * step))
            out.append({"first": k * step, "at": at[held], "tokens": [r for _, r in hits[held]]})
        return len(words), out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [of(t) for t in batch["__text"]]
            yield batch[keys].assign(n_words=[n for n, _ in found], blocks=[b for _, b in found])

    schema = StructType(documents.select(*keys).schema.fields + StructType.fromDDL("n_words long, blocks array<struct<first:int,at:array<int>,tokens:array<int>>>").fields)
    return documents.select(*keys, F.coalesce("text", F.lit("")).alias("__text")).mapInPandas(run, schema)


def contained(held: DataFrame, templates: tuple[Template, ...], rank: dict[str, int]) -> DataFrame:
    """row, first, at, tokens of each block with every template that it contains (label, base, words, phrase, share): the set-similarity join."""
    index = [
        (token, i, t.size, t.need, sorted(rank[w] for w in set(t.words)), [rank[w] for w in t.words], t.label, t.phrase)
        for t in templates
        for i, token in enumerate(prefix(t, rank))
    ]
    schema = "token int, i int, t_size int, need int, t_set array<int>, words array<int>, label string, phrase boolean"
    entries = held.sparkSession.createDataFrame(index, schema)
    entries = F.broadcast(entries) if len(index) <= BROADCAST else entries
    sets = held.withColumn("set", F.array_sort(F.array_distinct("tokens")))
    probes = sets.select("*", F.size("set").alias("size"), F.posexplode("set").alias("j", "token"))
    met = probes.join(entries, "token").where((F.col("size") >= F.col("need")) & (F.least(F.col("t_size") - F.col("i"), F.col("size") - F.col("j")) >= F.col("need")))
    common = F.array_intersect("set", "t_set")
    met = met.withColumn("common", common).where((F.size("common") >= F.col("need")) & (F.array_min("common") == F.col("token")))  # once a pair: by the rarest
    return met.withColumn("share", F.size("common") / F.col("t_size")).drop("set", "size", "j", "token", "i", "t_set", "common")


def scan(documents: DataFrame, keys: list[str], phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """The keys of every row with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts the places of the phrases, first_word and last_word are their smallest and largest start
    (null without any). labels are those of phrases and of notices that some block contains; both lists
    are distinct, sorted and joined by commas, empty without any. score is the largest share of a template's words that made
    it a label, else 0. Null and empty texts have no words. Repeated rows, and rows without key, are scanned
    each; columns that are no keys are not read. An empty table stays empty.
    """
    templates = (*phrases, *notices)
    step = max(len(t.words) for t in templates)
    rank = ranks(documents, sorted({w for t in templates for w in t.words}))
    named = {f"__{i}": k for i, k in enumerate(keys)}
    docs = documents.select(*[F.col(k).alias(n) for n, k in named.items()], "text")
    rows = written(blocks(docs, list(named), templates, rank, step).withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    held = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    met = contained(held, templates, rank)
    here = F.filter(
        F.sequence(F.lit(0), F.size("at") - 1),
        lambda x: (F.slice("tokens", x + 1, F.size("words")) == F.col("words"))
        & (F.get("at", x + F.size("words") - 1) - F.get("at", x) == F.size("words") - 1)
        & (F.get("at", x) < F.col("first") + step),
    )  # what begins in the second half is the next block's
    met = met.withColumn("places", F.when(F.col("phrase"), F.transform(here, lambda x: F.get("at", x))))
    met = met.where(~F.col("phrase") | (F.size("places") > 0))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = met.groupBy("row").agg(
        F.sum(F.when(F.col("phrase"), F.size("places"))).alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"), F.max(F.array_max("places")).cast("long").alias("last_word"),
        listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max("share").alias("score"),
    )
    full = rows.select(*named, "n_words", "row").join(found, "row", "left")
    return full.select(
        *[F.col(n).alias(k) for n, k in named.items()], "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


_ROWS = ", ".join(f"('{t.label}', {t.phrase}, {[w for w in t.words]}, {t.size}, {t.need})" for t in (*PHRASES, *NOTICES))
_STEP = max(len(t.words) for t in (*PHRASES, *NOTICES))
SQL = rf"""
with t(label, phrase, words, size, need) as (values {_ROWS}
), d as materialized (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), p as (
  select r, label, i as place from d, unnest(range(len(w))) x(i), t where phrase and w[i + 1:i + len(words)] = words
), b as (
  select r, list_distinct(w[i + 1:i + 2 * {_STEP}]) as s from d, unnest(range(0, len(w), {_STEP})) x(i)
), n as (
  select r, label, len(list_intersect(s, list_distinct(words))) / size as share from b, t
  where not phrase and len(list_intersect(s, list_distinct(words))) >= need
), base as (
  select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from p group by r
), every as (
  select r, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from (select r, label, 1.0::double as share from p union all select r, label, share from n) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join base using (r) left join every using (r)
"""
