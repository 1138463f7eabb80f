"""URL filters against a plain loop over all rules, odd urls and empty tables."""

import random
import re

from skyframe.llm import url_filter

PAGES = "page_id long, url string, key string, uid string, part int"
RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [
        (len(h) + len(p or ""), len(h), h + (p or ""), verdict) for h, p, verdict in rules
        if h is not None and verdict is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, **more):
    rows = [(i % 7 or None, u, "x", "y", 1) for i, u in enumerate(urls)]
    out = url_filter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(rules, RULES), **more)
    got = sorted(map(str, map(tuple, out.collect())))
    want = sorted(str((k, *brute(u, rules, **more))) for k, u, *_ in rows)
    assert got == want


def test_random_nested_rules(spark):
    rng = random.Random(3)
    labels, parts = ["com", "net", "a", "b", "aa", "a-b", "é", "", "example"], ["", "/", "/en", "/en/", "/english/x", "/de/", "/d", "//", "/en/é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(3), rng.choice(parts)) for _ in range(150))}.values())
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host(4)}{rng.choice(parts)}{rng.choice(['', 'x', '?q=/', '#a', '/../'])}" for _ in range(3000)]
    judged(spark, urls, rules)


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("net", None, "allow"), (None, "/", "block"), ("org", "/", None)]
    urls = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://xnet/", "http://a.Example.NET/en/?x", "http://example.net/en", "http://example.net?/en/",
            "x://y://example.net/en/", "http://net:80/", "http://.net/", "http://example.net/EN/", "http://net\n/", "http://org/" + "p" * 200_000]
    judged(spark, urls + urls, rules)
    judged(spark, urls, [], default="block")
    judged(spark, [], rules)


def test_hot_host(spark):
    """A host that holds nearly all rows, with more path rules than ranges."""
    rules = [("net", f"/{i}/", ["allow", "block"][i % 2]) for i in range(300)] + [("net", "/", "block"), ("a.net", "/7/", "block")]
    judged(spark, [f"http://a.net/{i % 400}/{i}" for i in range(4000)] + ["http://a.net/7/"] * 3000, rules)


def test_a_rule_with_two_verdicts_blocks(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("NET", "/", "allow")], RULES)
    out = url_filter.judge(spark.createDataFrame([(1, "http://net/", "", "", 1)], PAGES), rules)
    assert [tuple(r) for r in out.collect()] == [(1, "net", "/", "net/", "block")]
