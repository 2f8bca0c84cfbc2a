import random

import pytest

from netshield.llm import warc
from netshield.llm.queries import op10_warc

SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, canonical int"


def canon(url):
    if url is None or "://" not in url.split("#")[0]:
        return None
    scheme, rest = url.split("#")[0].split("://", 1)
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = host.lower()
    port = {"http": ":80", "https": ":443"}.get(scheme.lower())
    if port and host.endswith(port):
        host = host[:-len(port)]
    params = sorted(p for p in query.split("&") if p and p.split("=")[0] not in warc.TRACKING)
    return host.removeprefix("www.") + (slash + path).rstrip("/") + ("?" + "&".join(params) if params else "")


def brute(rows):
    key = lambda r: tuple((x is not None, x or 0) for x in (r[2], r[0]))
    low = lambda h: {k: v or "" for k, v in sorted((k.lower(), v or "") for k, v in (h or {}).items())}
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        c, headers = canon(r[1]), low(r[5])
        found = [b for b in rows if b[3] == "response" and b[4] == 200 and b[6] is not None and c is not None
                 and canon(b[1]) == c and key(b) < key(r)]
        if not found:
            out.append((r[0], r[1], r[2], None, "missing", headers, r[6]))
            continue
        base = max(found, key=key)
        old = low(base[5])
        if "etag" in headers and "etag" in old:
            good = headers["etag"].removeprefix("W/") == old["etag"].removeprefix("W/")
        elif "last-modified" in headers and "last-modified" in old:
            good = headers["last-modified"] == old["last-modified"]
        else:
            good = r[6] is None or r[6] == base[6]
        if good:
            out.append((r[0], r[1], r[2], base[0], "resolved", old | {k: v for k, v in headers.items() if k in warc.UPDATED}, base[6]))
        else:
            out.append((r[0], r[1], r[2], None, "changed", headers, r[6]))
    return sorted(out, key=repr)


def tuples(df):
    return sorted(((r.record_id, r.url, r.ts, r.refers_to, r.outcome, dict(sorted(r.headers.items())), r.digest) for r in df.collect()), key=repr)


def sorted_headers(rows):
    return sorted(((*r[:5], dict(sorted(r[5].items())), r[6]) for r in rows), key=repr)


URLS = ["http://A.com/x", "https://www.a.com:443/x/#f", "http://a.com:80/x?utm_source=q&", "http://a.com/x?b=2&a=1", "HTTP://a.com/x?a=1&ref=z&b=2",
        "http://b.com", "http://b.com/", None, "no url", "http://a.com/X", "a://b://c"]


@pytest.mark.parametrize("slice_rows", [1, 7, 10**6])
def test_matches_definition(spark, slice_rows):
    rng = random.Random(slice_rows)
    rows = []
    for i in range(400):
        headers = {k: v for k, v in {"ETag": rng.choice(['"1"', 'W/"1"', '"2"', None]), "Last-Modified": rng.choice(["d1", "d2"]),
                                     "Content-Length": "5", "Server": str(i), "X-Y": None}.items() if rng.random() < 0.5}
        rows.append((i, rng.choice(URLS), rng.choice([None, rng.randint(0, 60)]), rng.choice(["response", "revisit", "revisit", "request"]),
                     rng.choice([200, 200, 404, None]), headers if rng.random() < 0.9 else None, rng.choice(["s1", "s2", None]), 1))
    rows += [(None, "http://b.com", 30, "revisit", 304, {}, None, 1)] * 2 + [(None, None, None, "revisit", None, None, None, 1)]
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA), slice_rows)
    assert tuples(got) == sorted_headers(brute(rows))
    assert "Python" not in got._jdf.queryExecution().toString()


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_url(spark):
    rows = [(i, "http://a.com/", i, "response" if i % 50 == 0 else "revisit", 200, {"ETag": f'"{i // 100}"'}, str(i), 1) for i in range(3000)]
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA), 100)
    assert tuples(got) == sorted_headers(brute(rows))


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in warc.captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()]
    want = [(r[0], r[3], r[4], "\n".join(f"{k}: {v}" for k, v in sorted(r[5].items())), r[6]) for r in brute(rows)]
    got = [(r.record_id, r.refers_to, r.outcome, r.headers, r.digest) for r in op10_warc(spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} >= {"resolved", "changed"}
