"""URL rules against a plain statement of them."""

import random

from lagmill.llm.queries import URL_RULES
from lagmill.llm.urls import judge_urls


def plain(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow" if host else "block"


def test_rules(spark):
    rng = random.Random(2)
    rules = [*URL_RULES, ("a.b", "/x", "block"), ("b", "", "allow"), ("c", "/p/q/r", "block"), ("net", "/", "allow")]
    urls = [None, "", "no scheme", "http://", "x://y://z/", "HTTP://EXAMPLE.NET/EN/", "http://example.net?en/", "http://é.net/ß#f", "http://" + "a." * 3000 + "net/" + "p/" * 3000,
            "http://a.b/x", "http://a.b/xyz", "http://a.b/", "http://c/p/q/rest", "http://c/p/q", "http://notexample.net/en/a", "http://net/"]
    for _ in range(300):
        urls.append("http://" + ".".join(rng.choice(["example", "net", "com", "org", "www", "b", "a"]) for _ in range(rng.randint(1, 4)))
                    + rng.choice(["", "/", "/en/", "/de/x", "/fr/y/z", "/x", "?q=/en/", "/en#/"]))
    urls += urls[:5]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, rule string, digest string")
    known = spark.createDataFrame([*rules, (None, "/", "block"), ("z", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, known).collect()}
    assert got == {k: plain(u, rules) for k, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), known).count() == 0
    assert {r.verdict for r in judge_urls(pages, known.limit(0)).collect()} == {"allow", "block"}
