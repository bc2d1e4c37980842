from __future__ import annotations

import re

from logloom.llm import queries, url_rules


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    fits = [(len(h + p), len(p), a == "block", h + p, a) for h, p, a in rules
            if None not in (h, p, a) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_odd_urls(spark):
    rules = [*queries.URL_RULES, ("", "", "block"), ("a.b", "", "block"), ("b", "/x", "allow"), ("b", "/x", "block"), (None, "/", "block"), ("c", None, "allow")]
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "x://A.Example.ORG/es/1?q", "http://example.org/es", "http://badexample.org/es/",
            "http://example.org/en/14#x", "http://e.com/de/y", "http://a.b?x", "http://z.a.b/x", "http://b/x/y", "http://b/xy", "http://é.b/x", "a://b://c/d",
            "http://x.org:80/es/", "http://org./", "http://..org/", "http://h\nost.org/p\nq", "http://" + "s." * 500 + "org/" + "p" * 5000]
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, "http://org/", None, None), (5, "http://org/", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    found = url_rules.judge_urls(pages, table)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, *plain(u, rules)) for i, u, _, _ in rows), key=repr)
    assert {r["verdict"] for r in url_rules.judge_urls(pages, table.limit(0), "block").collect()} == {"block"}
    assert url_rules.judge_urls(pages.limit(0), table).count() == 0
