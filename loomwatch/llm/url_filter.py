"""URL filtering with a cascade of Bloom filters, in DataFrame functions only.

The listed keys are rule strings (host and path together, such as ``example.com/de/``). A URL's own keys are
its host's suffixes, each followed by a prefix of its path; only suffixes with as many labels and prefixes of
as many characters as some rule has can be listed, so only those are made. Level 1 holds the listed keys,
level 2 those keys of the whole corpus that pass level 1 by mistake, level 3 the listed keys that pass level 2
by mistake, and so on until a level has no mistakes. For any key of the corpus the first level that refuses it
decides: exact membership, with no join when URLs are judged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.common import ascii_lower, shared_dir, table

#: Bits of a byte of a filter: seven, so that a byte is an ASCII character and its value a built-in function.
PER_BYTE = 7


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ? or #. Both empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """A URL's keys that could be listed."""
    labels = sorted({r.host.count(".") + 1 for r in rules}, reverse=True)
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    parts = F.split(host, r"\.", -1)
    suffixes = {n: F.array_join(F.slice(parts, -n, n), ".") for n in labels}
    made = [
        F.when((F.size(parts) >= n) & (F.length(path) >= m), F.concat(suffixes[n], F.substring(path, 1, m)))
        for n in labels
        for m in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*made)))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    held: bytes

    def passes(self, key: Column) -> Column:
        """Whether all of the key's bits are set; the bytes are one constant in the plan."""
        held, found = F.lit(self.held), F.lit(True)
        for p in positions(key, self.bits, self.hashes, self.seed):
            byte = F.ascii(F.substring(held, (F.floor(p / PER_BYTE) + 1).cast("int"), F.lit(1)).cast("string"))
            found = found & (byte.bitwiseAND(bit(p)) != 0)
        return found


def bit(p: Column) -> Column:
    """The bit of position p within its byte."""
    return F.call_function("shiftleft", F.lit(1), F.pmod(p, F.lit(PER_BYTE)).cast("int"))


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the n keys in column key, its bytes made by a bitwise aggregate."""
    bits = max(PER_BYTE * 8, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / max(1, n) * math.log(2))) if n else 1
    hashes = min(hashes, 32)
    set_bits = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    made = set_bits.groupBy(F.floor(F.col("p") / PER_BYTE).alias("at")).agg(F.bit_or(bit(F.col("p"))).alias("v"))
    held = bytearray(-(-bits // PER_BYTE))
    for r in made.toLocalIterator():  # as many as the list, which the driver holds, has bits
        held[r["at"]] = r["v"]
    return Level(bits, hashes, seed, bytes(held))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether the key is listed; exact for the keys of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float | None = None, rate: float = 0.5, seed: int = 11) -> Cascade:
    """listed, universe: one column key. The universe is scanned for its size and for the first level's mistakes; later levels are made of those.

    Without a first_rate the first level lets through about as many keys of the universe as are listed, so
    that all levels together grow with the list, and with the universe only by its logarithm.
    """
    shared_dir(listed.sparkSession)  # where the checkpoints go
    listed = listed.where("key is not null").distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    if first_rate is None:
        size = universe.agg(F.approx_count_distinct("key")).first()[0]
        first_rate = min(0.5, max(1e-12, n / max(1, size)))
    levels = [build_level(listed, n, first_rate, seed)]
    wrong = universe.where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti").checkpoint()
    inside, outside = listed, wrong
    while (n := outside.count()):
        levels.append(build_level(outside, n, rate, seed + len(levels)))
        inside, outside = outside, inside.where(levels[-1].passes(F.col("key"))).checkpoint()
        if len(levels) > 64:
            raise RuntimeError("the cascade does not end")
    return Cascade(tuple(levels))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to the rows. Columns of these names are replaced.

    A rule fits its host and all subdomains of it if the path starts with the rule's; the longest wins.
    No rule: rule is null and the verdict is that of the method, ``default`` for keys that no list holds.
    Null, empty or unparsable URLs have an empty host and path, fit no rule and get the default.
    Repeated rows are judged alike; an empty table stays empty.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = url_keys(F.col("host"), F.col("path"), rules)
    universe = parsed.select(F.explode(keys).alias("key"))
    cascades = {
        action: build_cascade(spark.createDataFrame([(r.key,) for r in rules if r.action == action], "key string"), universe)
        for action in ("allow", "block")
    }
    actions = [(a, c) for a, c in cascades.items() if c.levels]
    judged = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(*[F.when(c.holds(k), F.lit(a)) for a, c in actions]).alias("action")))
    best = F.array_sort(F.filter(judged, lambda j: j["action"].isNotNull()), lambda a, b: (F.length(b["key"]) - F.length(a["key"])).cast("int"))
    return (
        parsed.withColumn("__hit", F.get(best, F.lit(0)))
        .withColumns({"rule": F.col("__hit.key"), "verdict": F.coalesce(F.col("__hit.action"), F.lit(default))})
        .drop("__hit")
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') as path
  from u
), r(rule, rhost, rpath, action) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), f as (
  select p.page_id, p.host, p.path, r.rule, r.action, row_number() over (partition by p.page_id order by length(r.rule) desc) as k
  from p left join r on (p.host = r.rhost or suffix(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from f where k = 1
"""
