import random

from quillon.llm import bloom, urls
from quillon.llm.queries import QUERIES, URL_BLOCK_LIST, URL_RULES


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def brute(url, listed):
    host, path = split(url)
    fits = [(rank, len(h + p), len(h), h + p, v) for h, p, v, rank in listed if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


URLS = [
    "http://a.org/x", "https://WWW.Example.ORG/es/1?q", "http://example.org/en/17", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/9#z",
    "http://free-bets.example.com/en/1", "http://m.free-bets.example.com/fr/1", "http://notfree-bets.example.com/", None, "", "no scheme", "http://", "http:///path", "http://h", "http://h?x/y", "HTTP://É.org/", "a\nb://q.com/de/", "x://y://z.org/", "http://org/", "http://com/de/",
]


def test_rules_against_brute_force(spark, tables):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[1], None)]
    d = tables("pages", rows, "page_id long, url string, html string")
    listed = [(h, p, v, 2) for h, p, v in URL_RULES] + [(h, p, "block", 1) for h, p in URL_BLOCK_LIST]
    out = QUERIES["op5_bloom_url_filter"](spark, d).collect()
    want = []
    for i, u, _ in rows:
        host, path, entry, verdict = brute(u, listed)
        ruled = entry if entry in {h + p for h, p, _ in URL_RULES} else None
        want.append((i, host, path, ruled, verdict))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_long_list_and_no_list(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.example.net" for i in range(3000)]
    listed = [(h, "/", "block", 1) for h in hosts[::3]] + [(h, "/a/", "allow", 1) for h in hosts[::5]]
    df = spark.createDataFrame(listed, "host string, path string, verdict string, rank int")
    rows = [(i, f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{rng.choice(['a/b', 'c', ''])}") for i in range(2000)]
    pages = spark.createDataFrame(rows, "id long, u string")
    out = {r["id"]: (r["host"], r["path"], r["entry"], r["verdict"]) for r in urls.judge(pages, "id", "u", df).collect()}
    assert out == {i: brute(u, listed) for i, u in rows}
    none = urls.judge(pages, "id", "u", df.limit(0)).collect()
    assert len(none) == 2000 and {r["verdict"] for r in none} == {"allow"}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    inside = spark.range(0, 5000).selectExpr("xxhash64(id) AS h")
    words = bloom.build(inside, "h", 5000)
    from pyspark.sql import functions as F

    got = spark.range(0, 20_000).select("id", bloom.passes(words, F.xxhash64("id"), 5000).alias("p")).collect()
    assert all(r["p"] for r in got if r["id"] < 5000)
    assert sum(r["p"] for r in got if r["id"] >= 5000) < 15_000 * 0.05
