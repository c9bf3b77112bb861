import re

from hookline.llm import url_rules
from hookline.llm.queries import URL_RULES


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def run(spark, scratch, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, stack int")
    named = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, named, scratch).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


ODD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/EN/", "http://notexample.net/en/",
    "http://example.com/de/", "http://a.b.example.com/de/q", "http://example.com/de", "x://y://z", "http://org/fr/1", "http://a.org?q=/fr/", "http://a.org#/fr/",
    "http://.net/", "http://a..net/", "http://ü.net/", "a\nb://c.net/d", "http://example.net:80/en/", "http://example.net/en/" + "p" * 3000,
]


def test_fixed_rules(spark, sf, scratch):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    run(spark, scratch, urls + ODD + ["http://hot.example.net/en/1"] * 40, URL_RULES)


def test_nested_rules(spark, scratch):
    rules = [("a.b.c", p, v) for p, v in (("/", "block"), ("/x", "allow"), ("/x/", "block"), ("/x/y/", "allow"))]
    rules += [("b.c", "/x/y/z", "block"), ("c", "", "allow"), ("c", "/x/y/z/w/long", "block"), ("d.c", "/", "block")]
    urls = [f"http://{h}{p}" for h in ("c", "b.c", "a.b.c", "q.a.b.c", "bb.c", "d.c", "cc", "e.d.c") for p in ("", "/", "/x", "/xy", "/x/", "/x/y/z", "/x/y/z/w/longer", "/y")]
    run(spark, scratch, urls, rules)


def test_empty(spark, scratch):
    run(spark, scratch, ["http://a.net/"], [("zzz", "/", "block")])
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, none, scratch).collect()] == [(1, "http://a.net/", "a.net", "/", None, "allow")]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_rules.judge_urls(pages.limit(0), rules, scratch).count() == 0
