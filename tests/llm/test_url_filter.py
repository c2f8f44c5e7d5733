"""URL rules against a loop over all rules."""

import random

import pytest

from stayspark.llm import url_filter
from stayspark.llm.queries import URL_RULES
from stayspark.llm.url_filter import Rule


def plain(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def test_trie_equals_a_loop_on_random_rules():
    pick = random.Random(3)
    hosts = ["a", "b.a", "c.b.a", "bb.a", "a.b", "b", "x.c.b.a", ""]
    paths = ["", "/", "/p", "/p/", "/p/q", "/pq", "/p/qr/s", "//", "/p//q", "/é/x"]
    for _ in range(400):
        rules = [
            Rule(pick.choice(["allow", "block"]), pick.choice(hosts[:-1]), pick.choice(paths))
            for _ in range(pick.randrange(12))
        ]
        trie = url_filter.Trie(rules)
        for host in hosts:
            for path in paths:
                assert trie.fit(trie.hosts(host), path) == plain(rules, host, path)


def test_odd_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/en/12?x#y"), (5, "http://notexample.org/es/"),
        (6, "http://org"), (7, "x://a.org#/en/1"), (8, "http://com/de/://x"), (9, "http://É.com/fr/"), (9, "http://É.com/fr/"),
        (10, "http://example.org:80/es/"), (11, "http://example.org/" + "a/" * 20_000), (None, "http://a.net/\nb"),
    ]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, rule string, host string")
    got = sorted(map(tuple, url_filter.judge_pages(frame, URL_RULES).collect()), key=lambda r: r[0] or 0)
    want = [
        (None, "a.net", "/\nb", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "a.example.org", "/en/12", "example.org/en/1", "block"), (5, "notexample.org", "/es/", "org/", "allow"),
        (6, "org", "", None, "allow"), (7, "a.org", "", None, "allow"), (8, "com", "/de/://x", "com/de/", "block"),
        (9, "É.com", "/fr/", "com/fr/", "allow"), (9, "É.com", "/fr/", "com/fr/", "allow"), (10, "example.org:80", "/es/", None, "allow"),
        (11, "example.org", "/" + "a/" * 20_000, "org/", "allow"),
    ]
    assert got == want
    assert {r.verdict for r in url_filter.judge_pages(frame, [], "block").collect()} == {"block"}
    assert url_filter.judge_pages(frame.limit(0), URL_RULES).collect() == []


def test_rules_are_checked():
    with pytest.raises(ValueError):
        url_filter.Trie([Rule("maybe", "org")])


@pytest.mark.parametrize("limit", [1, 2])
def test_rules_beyond_one_trie(spark, monkeypatch, limit):
    rules = [*URL_RULES, Rule("allow", "example.org", "/es/"), Rule("block", "example.org", "/es/"), Rule("allow", "a.org", "")]
    urls = [
        "http://a.org/", "http://x.example.org/es/1", "http://example.org/en/12", "http://b.com/fr/", "http://b.com/de/", "http://c.net/", None,
    ]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(map(tuple, url_filter.judge_pages(frame, rules).collect()))
    monkeypatch.setattr(url_filter, "MAX_RULES", limit)
    assert sorted(map(tuple, url_filter.judge_pages(frame, rules).collect())) == want
