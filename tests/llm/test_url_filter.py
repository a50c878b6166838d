import random

import pytest

from slimctx.llm import url_filter as U


def test_patterns(spark):
    urls = ["https://u:p@A.Example.com:8080/x//y/z.html?q=/w#f", "http://localhost/", "http://localhost",
            "nonsense", "", None, "ftp://b.c/d?x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = {r.i: list(r.p) for r in df.select("i", U.url_patterns(df.url).alias("p")).collect()}
    assert got == {0: ["a.example.com", "example.com", "a.example.com/x", "a.example.com/x/y",
                       "a.example.com/x/y/z.html"], 1: ["localhost"], 2: ["localhost"], 3: [], 4: [],
                   5: [], 6: ["b.c", "b.c/d"]}


def brute(captures, changes):
    rank = {"remove": 1, "block": 2, "allow": 3}
    hist = {}
    for ch in set(changes):
        if None not in ch:
            lst, pat, act, at = ch
            key = hist.setdefault((lst, pat), {})
            key[at] = max(key.get(at, "remove"), act, key=rank.get)
    out = {}
    for page, url, t in set(captures):
        hits = []
        for (lst, pat), h in hist.items():
            if url is None or t is None:
                continue
            host, _, path = url.split("://", 1)[1].partition("/")
            full = host + "".join("/" + s for s in path.split("/") if s)
            ok = full == pat or full.startswith(pat + "/") if "/" in pat else (
                host == pat or host.endswith("." + pat))
            past = [at for at in h if at <= t]
            if ok and past and h[max(past)] != "remove":
                hits.append((-len(pat), h[max(past)], lst, max(past), pat))
        best = min(hits, default=None)
        out[page, url, t] = (len(hits), best[1] if best else "none", best[2] if best else None,
                             best[4] if best else None)
    return out


@pytest.mark.parametrize("limit", [U.MAX_BROADCAST, 0])
def test_against_brute_force(spark, limit):
    rnd = random.Random(6)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org", "deep.a.x.com", "local"]
    pats = hosts + ["a.x.com/p", "a.x.com/p/q", "y.org/p", "com.x"]
    caps = [(i, f"http://{rnd.choice(hosts)}/{rnd.choice(['', 'p', 'p/q', 'pq', 'p/q/r'])}",
             rnd.randint(0, 400) * 86_400) for i in range(200)]
    caps += [(500, None, 5), (501, "http://x.com/", None), caps[0], caps[0], (None, "http://y.org/p", 9 ** 7)]
    changes = [(rnd.choice(["L", "M"]), rnd.choice(pats), rnd.choice(["block", "allow", "remove"]),
                rnd.randint(0, 40) * 10 * 86_400) for _ in range(120)]
    changes += [changes[0], (None, "x.com", "block", 0), ("L", "x.com", None, 0), ("L", None, "block", 0)]
    c = spark.createDataFrame([(*x, 0, 0) for x in caps],
                              "page_id long, url string, fetched long, list_id int, nth int")
    h = spark.createDataFrame([(*x, 0) for x in changes],
                              "list_id string, pattern string, action string, at long, bucket int")
    rows = U.url_filter(c, h, max_broadcast=limit).collect()
    got = {(r.page_id, r.url, r.fetched): (r.n_active, r.verdict, r.list_id, r.pattern) for r in rows}
    assert len(rows) == len(got) and got == brute(caps, changes)


def test_empty(spark):
    c = spark.createDataFrame([(1, "http://a.b/c", 3)], "page_id long, url string, fetched long")
    h = spark.createDataFrame([("l", "a.b", "block", 1)],
                              "list_id string, pattern string, action string, at long")
    assert [r.verdict for r in U.url_filter(c, h.limit(0)).collect()] == ["none"]
    assert U.url_filter(c.limit(0), h).count() == 0
    assert [r.verdict for r in U.url_filter(c, h).collect()] == ["block"]
