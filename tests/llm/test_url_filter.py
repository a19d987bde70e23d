import random

import pytest
from pyspark.sql import functions as F

from voucherflow.llm import url_filter as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h) + len(p or ""), h.count("."), len(p or ""), v, h + (p or "")) for h, p, v in rules
           if h and v in ("allow", "block") and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    best = max(fit, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


def judged(spark, urls, rules, **kw):
    pages = spark.createDataFrame([(n, u, "h", "p", "r", "v", 1) for n, u in enumerate(urls)],
                                  "page_id long, url string, host string, path string, rule string, verdict string, best int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = U.judge(pages, table, **kw).orderBy("page.page_id").collect()
    assert [(r["page"]["host"], r["page"]["verdict"]) for r in got] == [("h", "v")] * len(urls)     # clashing columns come back as they are
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got]


def some_urls(n, seed=1):
    r = random.Random(seed)
    hosts = ["org", "Example.ORG", "a.example.org", "xexample.org", "b.c.com", "com", "example.com", "net", "a..com", "user@x.com:80", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/fr/", "/fr/x#y", "/de/", "/DE/", "/dé/é", "?q=/de/", "#/de/"]
    return [r.choice(["http://", "HTTPS://", "://", "", "a://b://"]) + r.choice(hosts) + r.choice(paths) for _ in range(n)]


@pytest.mark.parametrize(("prefix", "most"), [(8, 100_000), (1, 100_000), (1, 0)])
def test_equals_brute_force(spark, monkeypatch, prefix, most):
    """With one hex digit nearly all expressions share a prefix with a rule; only the digest tells. Without a broadcast rules are shuffled."""
    monkeypatch.setattr(U, "BROADCAST_RULES", most)
    r = random.Random(5)
    more = [(r.choice(["a.com", "b.com", "com", "x.example.org"]), "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 4))), r.choice(["allow", "block"])) for _ in range(60)]
    rules = RULES + list({(h, p): (h, p, v) for h, p, v in more}.values())
    urls = some_urls(300) + [f"http://{r.choice(['a.com', 'z.a.com', 'b.com', 'q.x.example.org'])}/" + "".join(r.choice("ab/") for _ in range(5)) for _ in range(300)]
    assert judged(spark, urls, rules, prefix=prefix) == [brute(u, rules) for u in urls]


def test_awkward_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/de/" + "x/" * 20_000, "http://" + "a." * 500 + "org/es/", "http://com/de/", "http://com/de/", "http://com\n/de/"]
    rules = RULES + [(None, "/", "block"), ("", "", "block"), ("com", None, "allow"), ("net", "/", "other"), ("ORG", "/", "block")]
    got = judged(spark, urls, rules)
    assert [g[2:] for g in got] == [(None, "allow")] * 4 + [("com", "allow"), ("com/de/", "block"), ("org/", "block"), ("com/de/", "block"), ("com/de/", "block"), (None, "allow")]
    assert judged(spark, [], rules) == [] and judged(spark, ["http://com/de/"], []) == [("com", "/de/", None, "allow")]


def test_one_url_for_a_third_of_the_rows(spark):
    urls = some_urls(200) + ["http://a.example.org/en/17"] * 100
    assert judged(spark, urls, RULES) == [brute(u, RULES) for u in urls]


def test_rules_are_broadcast_only_up_to_the_bound(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plans = []
    for most in (100_000, 0):
        monkeypatch.setattr(U, "BROADCAST_RULES", most)
        plans.append(U.judge(pages, rules)._jdf.queryExecution().optimizedPlan().toString())
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]
    assert U.judge(pages.withColumn("x", F.lit(1)), rules).columns == ["page", "host", "path", "rule", "verdict"]
