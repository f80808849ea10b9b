"""Secret scans: three patterns and dictionary-primed zstandard novelty.

Beside the patterns, a run of key-like characters near a sensitive word, on either side, is a candidate. It is
compressed together with the code around it, with and without the candidate, by a compressor primed with
a dictionary of code and of the identifiers that many documents of the corpus use. The bytes that it adds measure how new it is: names, words and values
that the surroundings or the dictionary know add few, random material adds nearly its own length. A mean per character
sinks with length, so from LONG characters on it is held against the bits of the candidate's alphabet. Other
candidates in the surroundings teach the compressor the alphabet of keys, so novelty is measured without them; with
them a candidate need only add what random text of its alphabet does, which names that share parts don't.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words without which ASSIGN cannot match, and those that make a context sensitive.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
SENSITIVE_WORDS = ("key", "token", "secret", "passw", "pwd", "auth", "cred", "bearer", "private", "signature", "session", "cookie", "salt", "nonce")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
#: A run of key-like characters, with the padding of base64 where no value follows.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Characters between sensitive word and candidate, of context on either side, and least novelty (bytes a character).
REACH, AROUND, NOVELTY = 40, 200, 0.75
#: Share of its entropy that a candidate must add among other candidates.
AMONG = 0.5
#: Characters from which novelty need not exceed what random text of the same alphabet holds.
LONG = 64
#: A name of letters that a value is assigned to, or the rest of one.
NAME = re.compile(r"""[A-Za-z_/-]+["']?[ \t]*[:=]+[ \t]*["'(\[{<]?[\w.$+/-]""")
#: Capitals in a row before a small letter: names have few, random letters many.
JUMBLED = re.compile("[A-Z]{2,}[a-z]")
PREFIX = re.compile("[A-Za-z_/-]+")
HEX_DIGITS = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Words of the corpus in the dictionary at most, and documents that use such a word at least, lest it be a secret.
LEXICON, LEAST = 8192, 20
#: What code and configuration are made of: words, identifiers, digits and alphabets.
IDENTIFIERS = """
def class return import from self None True False if else elif for while try except finally with as lambda yield assert raise pass
public static void private protected final int long string boolean new this null true false function const let var export default
SELECT INSERT UPDATE DELETE FROM WHERE GROUP ORDER VALUES TABLE CREATE INDEX http https localhost example.com www api v1 v2
user username password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret
authorization bearer basic session cookie signature credentials config settings environment production staging development test
path file name value type size length count index start end data result response request header body content message error status
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef
"""


def entropy(own: str) -> float:
    """Bytes a character of random text of the candidate's alphabet."""
    digits, small, large = (any(map(test, own)) for test in (str.isdigit, str.islower, str.isupper))
    letters = 26 * max(1, small + large) if digits else 26
    alphabet = 10 if own.isdigit() else 16 if HEX_DIGITS.fullmatch(own) else letters + 10 * digits
    return math.log2(alphabet) / 8


def least_novelty(own: str) -> float:
    """NOVELTY, or for a long candidate its entropy if that is less."""
    return NOVELTY if len(own) < LONG else min(NOVELTY, entropy(own))


def named(text: str, start: int, end: int) -> bool:
    """Whether the run is a name that a value follows; a run padded to whole groups of four is none."""
    return NAME.match(text, start) is not None and not (text[end - 1] == "=" and (end - start) % 4 == 0)


def candidates(text: str, words: list[tuple[int, int]], runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs within REACH of a sensitive word, on either side; a run that starts with a name of letters that holds words begins after the last of these."""
    starts = [s for s, _ in words]
    for start, end in runs:
        inside = words[bisect_left(starts, start) : bisect_left(starts, min(end, start + REACH))]
        after = max((e for _, e in inside if PREFIX.fullmatch(text, start, e)), default=end)
        if end - after >= 16:
            yield after, end
            continue
        i = bisect_left(starts, start)
        near = i > 0 and start - words[i - 1][1] <= REACH
        i = bisect_left(starts, end + 1)  # what runs into a word is a name
        if near or (i < len(words) and starts[i] - end <= REACH):
            yield start, end


def apart(base: list[tuple[int, int]], spans: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that overlap none of the base."""
    starts = [s for s, _ in base]
    reach = list(accumulate((e for _, e in base), max))
    for start, end in spans:
        i = bisect_left(starts, end)
        if not i or reach[i - 1] <= start:
            yield start, end


class Scanner:
    def __init__(self, lexicon: str = "") -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict((lexicon + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False).compress

    def added(self, before: bytes, after: bytes, own: str) -> float:
        """Bytes that own adds to its compressed surroundings, a character."""
        return (len(self.compress(before + own.encode() + after)) - len(self.compress(before + after))) / len(own)

    def novelty(self, before: bytes, after: bytes, own: str) -> float:
        """What own adds; of spans without digits, which may be names in capitals, at most what their small letters add."""
        found = self.added(before, after, own)
        plain = any(x.isdigit() for x in own) or own == own.lower() or len(JUMBLED.findall(own)) > 1
        return found if plain else min(found, self.added(before, after, own.lower()))

    def novel(self, text: str, start: int, end: int, runs: list[tuple[int, int]]) -> bool:
        """Whether the span is new among its surroundings without other runs, and as new as random text among all."""
        own = text[start:end]
        low, high = max(0, start - AROUND), min(len(text), end + AROUND)
        sides = []
        for a, b in ((low, start), (end, high)):
            kept, at = [], a
            first = max(0, bisect_left(runs, (a, 0)) - 1)
            for s, e in runs[first : bisect_left(runs, (b, 0))]:
                if e > at and s < b and (e - s != len(own) or text[s:e] != own):
                    kept.append(text[at : max(at, s)])
                    at = min(b, e)
            sides.append("".join([*kept, text[at:b]]).encode())
        if self.novelty(*sides, own) < least_novelty(own):
            return False
        around = text[low:start].encode(), text[end:high].encode()
        return [*around] == sides or self.novelty(*around, own) >= AMONG * entropy(own)

    def base(self, text: str, low: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the three patterns, per kind leftmost and without overlap; those too short are dropped after matching."""
        found = []
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        low = text.lower()
        found = self.base(text, low)
        if any(w in low for w in SENSITIVE_WORDS):
            words = [m.span() for m in SENSITIVE.finditer(text)]
            runs = [m.span() for m in CANDIDATE.finditer(text)]
            base = sorted((s, e) for s, _, e in found)
            for start, end in apart(base, candidates(text, words, runs)):
                if not named(text, start, end) and self.novel(text, start, end, runs):
                    found.append((start, 3, end))
        return sorted(found)


def lexicon(documents: DataFrame, text: str = "text") -> str:
    """The words of letters that most documents use, at most LEXICON, those of most documents last, where a compressor reaches them best."""
    used = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z_]{4,40}"), F.lit(0)))
    counts = documents.select(F.explode(used).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    return " ".join(r["word"] for r in reversed(counts.orderBy(F.desc("n"), "word").limit(LEXICON).collect()))


def scan(documents: DataFrame, text: str = "text", known: str | None = None) -> DataFrame:
    """Adds spans, array<struct<kind, start, end>> in code points, end exclusive, by start and then kind as in KINDS.

    ``known`` are identifiers for the dictionary, those of the documents if not given. Null and empty texts have
    none. Rows stay as they are, repeated or without id; a column spans is replaced. Spans of the three patterns
    are never dropped for a novel one; novel spans don't overlap them.
    """
    shared = documents.sparkSession.sparkContext.broadcast(lexicon(documents, text) if known is None else known)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t or "")] for t in texts])

    return documents.withColumn("spans", found(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their text replaced by the mark; overlapping spans share one. n_chars follows where it is there."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans, strict=True):
            if found is None or not len(found):
                out.append(t)
                continue
            parts, at = [], 0
            for s in found:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], mark]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    columns = documents.columns
    found = scan(documents.select(F.struct(*columns).alias("row"), "text"))
    changed = F.size("spans") > 0
    new = {c: F.col(f"row.{c}") for c in columns}
    new["text"] = F.when(changed, cut(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    if "n_chars" in columns:
        new["n_chars"] = F.when(changed, F.length(new["text"]).cast("long")).otherwise(new["n_chars"])
    return found.select(*[v.alias(c) for c, v in new.items()])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[of(k) for k in KINDS[:3]], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
