import re

from newsloom.llm import url_rules
from newsloom.llm.queries import RULES


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if m and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_every_rule(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.B.NET/x", "https://example.net/en/1?q#f", "https://www.Example.net/EN/1", "https://x.example.com/de/", "https://x.example.com/de", "http://a.org/fr/x/y", "http://borg/fr/", "http://a.org?x=/fr/", "x://a://b.net/", "http://ÄÖ.net/ä", "http://u@h.net:80/p", "http://example.net/en", "http://a..net//en/", "http://net./"]
    urls += ["http://h.net/" + "a/" * 3000, "http://h.net/", "http://h.net/"]
    extra = [("h.net", "/a/a/b", "allow"), ("h.net", "/a/a", "block"), ("", "/", "block"), ("net", "", "allow")]
    for rules in (RULES, RULES + extra):
        pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(None, "http://net/", "c")], "page_id long, url string, host string")
        got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
        assert got == {(k, *brute(u, rules)) for k, u in [*enumerate(urls), (None, "http://net/")]}


def test_no_rules_no_rows(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert [r["verdict"] for r in url_rules.judge(pages, none).collect()] == ["allow"]
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, action string")).count() == 0
