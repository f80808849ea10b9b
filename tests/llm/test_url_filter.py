import pytest

from loomwatch.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.net/x", "http://anet/x", "https://Example.NET/en/1", "https://www.example.net/en", "https://x.example.net/de/", "ftp://example.com/de/x?y#z",
    "http://m.example.com/de/", "http://example.com?/de/", "http://example.com#a", "a://b://c.net/d", "http://q.org/fr/", "http://org/fr/x", "http://org/en/", "http://.net/", "http://a..net/x", "HTTP://É.NET/", "http://net:80/", "http://u@net/", "x" * 5000 + "://net/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://a.net\n/x", "http://a.net/é?",
]


def plain(url, rules=uf.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.action if best else "allow"


def test_against_plain_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(4, URLS[4], "x", "y")], "page_id int, url string, host string, key string")
    got = uf.url_filter(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert tuple(r)[1:] == plain(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert uf.url_filter(df.limit(0)).count() == 0
    assert {r["verdict"] for r in uf.url_filter(df, rules=()).collect()} == {"allow"}


@pytest.mark.parametrize("first_rate", [None, 0.01, 0.9])
def test_cascade_is_exact_over_its_universe(spark, first_rate):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) as key")
    cascade = uf.build_cascade(listed, universe, first_rate=first_rate)
    held = {r["key"] for r in universe.where(cascade.holds(universe["key"])).collect()}
    assert held == {f"k{i}" for i in range(0, 3000, 7)} and len(cascade.levels) >= 2
    assert universe.where(uf.build_cascade(listed.limit(0), universe).holds(universe["key"])).count() == 0


def test_many_rules(spark):
    rules = tuple(uf.Rule("block" if i % 3 else "allow", f"h{i}.com", "/" if i % 2 else "/a/") for i in range(1500))
    urls = [f"http://www.h{i}.com/{'a/' if i % 4 else 'b/'}x" for i in range(2000)]
    got = uf.url_filter(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string"), rules).collect()
    assert all((r["rule"], r["verdict"]) == plain(r["url"], rules)[2:] for r in got)
