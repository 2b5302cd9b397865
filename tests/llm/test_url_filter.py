import random

import pytest
from pyspark.sql import functions as F

from reckon.llm import url_filter


def plain(url, rules):
    """Host, path, rule and verdict by trying every rule."""
    rest = (url or "").partition("://")[2]
    host = rest
    for stop in "/?#":
        host = host.split(stop)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def frame(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")


ODD = [
    None, "", "no scheme", "://", "http://", "http:///x", "https://com", "https://com/", "https://COM/a", "http://example.com/en", "http://example.com/en/", "http://WWW.Example.com/en/x?y#z",
    "http://a.www.example.com/en/", "http://notexample.com/en/x", "http://x.net/es/", "http://x.net/ES/", "http://x.net?a=/es/", "http://x.net#/es/", "http://net/fr/", "a://b://net/fr/",
    "http://example.com./en/", "http://.com/", "http://u@example.com:80/en/", "http://x.net//es/", "http://ünï.net/es/ä\nb", "http://x.net/es/" + "a/" * 20000, "a" * 100000 + "://x.com/",
]


@pytest.mark.parametrize("trie_bytes", [url_filter.TRIE_BYTES, 0])
def test_odd_urls_with_the_rules_of_the_query(spark, trie_bytes):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = url_filter.judge_urls(frame(spark, ODD + ODD), rules, trie_bytes=trie_bytes).orderBy("page_id").collect()
    for r, u in zip(got, ODD + ODD, strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == plain(u, url_filter.RULES), u


@pytest.mark.parametrize("trie_bytes", [url_filter.TRIE_BYTES, 0])
def test_random_rules_equal_brute_force(spark, trie_bytes):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "co", "com", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "x", "/"]) + "/".join(rng.choice(["a", "ab", "abc", "", "b"]) for _ in range(rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)]
    rules += rules[:20]
    urls = [f"http://{host()}/{path()}" for _ in range(800)] + [f"http://{host()}" for _ in range(100)]
    df = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(frame(spark, urls), df, trie_bytes=trie_bytes).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [plain(u, rules) for u in urls]
    assert sum(r.rule is not None for r in got) > 300


def test_columns_that_clash_and_empty_tables(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = frame(spark, ["http://x.net/es/"]).select("page_id", F.lit("old").alias("host"), F.lit(1).alias("rule"), F.lit(2).alias("__host"), "url", F.lit(3).alias("a.b"))
    for least in (url_filter.TRIE_BYTES, 0):
        out = url_filter.judge_urls(pages, rules, trie_bytes=least)
        assert out.columns == ["page_id", "__host", "url", "a.b", "host", "path", "rule", "verdict"]
        assert tuple(out.first())[1:] == (2, "http://x.net/es/", 3, "x.net", "/es/", "net/es/", "block")
        assert url_filter.judge_urls(pages.limit(0), rules, trie_bytes=least).count() == 0
        assert url_filter.judge_urls(pages, rules.limit(0), trie_bytes=least).first().verdict == "allow"


def test_other_verdicts_are_an_error(spark):
    rules = spark.createDataFrame([("com", "/", "maybe")], "host string, path string, verdict string")
    with pytest.raises(Exception, match="no verdict: maybe"):
        url_filter.judge_urls(frame(spark, ["http://a.com/"]), rules).count()
