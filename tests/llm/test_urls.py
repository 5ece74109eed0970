from murkwater.llm import urls
from murkwater.llm.queries import URL_RULES

SOME = [
    "http://a.example.net/en/1", "https://example.net/en/", "http://example.net/en", "http://EXAMPLE.Net/en/x?y#z", "http://net/", "http://net", "http://x.net?a=/en/", "http://notexample.net/en/x", "ftp://fr.example.com/de/1",
    "http://example.com/DE/1", "http://org/fr/", "http://a.org/fr", "http://a.org/fr/b://c/d", "no scheme", "", None, "://net/x", "http:///x", "http://user@a.net:80/x", "http://a.net./x", "http://.net/x", "http://a..net/x\n/y", "http://ÉX.net/\U0001f600/", "x://y://net/z",
]


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, otherwise)


def run(spark, some, rules):
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    out = urls.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_equals_brute_force(spark):
    some = SOME + SOME[:5] * 3
    assert run(spark, some, URL_RULES) == {i: brute(u, URL_RULES) for i, u in enumerate(some)}


def test_many_rules(spark):
    rules = [("block", "net", ""), ("allow", "a.example.net", "/e"), ("block", "a.example.net", "/en/1"), ("allow", "example.net", "/en/x"), ("block", "com", "/de/1/2"), ("block", "y:", "//net/")]
    assert run(spark, SOME, rules) == {i: brute(u, rules) for i, u in enumerate(SOME)}
    assert {x[3] for x in run(spark, SOME, [("block", "nowhere", "/")]).values()} == {"allow"}


def test_equal_rules_and_empty_tables(spark):
    rules = [("allow", "net", "/"), ("block", "net", "/")]
    assert run(spark, ["http://x.net/"], rules)[0][3] == "block"
    assert run(spark, [], URL_RULES) == {}
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages, none).collect()} == {"allow"}


def test_very_long_urls_and_clashing_columns(spark):
    some = ["http://" + "a." * 300 + "net/" + "x/" * 5000, "http://example.net/en/" + "y" * 20_000 + "?q", "x" * 50_000]
    assert run(spark, some, URL_RULES) == {i: brute(u, URL_RULES) for i, u in enumerate(some)}
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string").selectExpr("*", "1 as known", "2 as rule", "3 as host", "4 as verdict", "5 as best", "6 as short")
    got = urls.judge(pages, spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert [(r.host, r.verdict) for r in got.collect()] == [("a.net", "block")] * 2
