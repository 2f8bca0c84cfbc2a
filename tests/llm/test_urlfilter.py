import random

import pytest

from netshield.llm import urlfilter
from netshield.llm.queries import URL_RULES, op1_urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    end = min([path.find(c) for c in "?#" if c in path] + [len(path)])
    return host, path[:end]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    best = None
    for h, p, action in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), h + p, action)
            best = max(best or key, key)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.COM/en/a?b=/c#d",
        "http://example.com/en", "http://example.com/en/", "http://xexample.com/en/", "ftp://a.b.net/es/1",
        "http://net/fr/", "http://n.net/frx", "http://n.net?x=/es/", "http://n.net#/es/", "x://y://example.com/en/",
        "http://.com/", "http://a..com/x", "http://com./", "http://example.com:80/en/", "http://ÉX.net/es/é\n/x?",
        "http://" + "a." * 5000 + "net/es/" + "p/" * 5000, "line\nbreak://net/fr/x"]


@pytest.mark.parametrize("limit", [urlfilter.BROADCAST_BYTES, 0])
def test_matches_definition(spark, limit):
    rng = random.Random(2)
    names = ["com", "net", "example", "www", "a"]
    urls = URLS + ["http://" + ".".join(rng.choices(names, k=rng.randint(1, 4))) + "/" +
                   "/".join(rng.choices(["en", "es", "x"], k=rng.randint(0, 3))) for _ in range(300)]
    rules = URL_RULES + [("a.net", "/e", "allow"), ("net", "/en/x", "block"), ("www.a.com", "", "block"),
                         ("A.com", "/en", "block"), ("a.com", "/en", "allow")]
    df = spark.createDataFrame([(i if i % 9 else None, u, "clash", "lead") for i, u in enumerate(urls)],
                               "page_id long, url string, rule string, lead string")
    df = df.union(df.limit(10))
    r = spark.createDataFrame(rules + [(None, "/", "block"), ("net", None, "block"), ("net", "/", "perhaps")],
                              "host string, path string, action string")
    out = urlfilter.judge(df, r, broadcast_bytes=limit).collect()
    assert len(out) == len(urls) + 10
    lower = [(h.lower(), p, a) for h, p, a in rules]
    for row in out:
        assert (row.host, row.path, row.rule, row.verdict) == brute(row.url, lower)
        assert row.lead == "lead"


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    assert urlfilter.judge(pages.limit(0), rules).collect() == []
    row = urlfilter.judge(pages, rules.limit(0), default="block").first()
    assert (row.host, row.rule, row.verdict) == ("a.com", None, "block")


def test_query(spark, sf_dir):
    rows = op1_urlfilter(spark, sf_dir).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], URL_RULES)
