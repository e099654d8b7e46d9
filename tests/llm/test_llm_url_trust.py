from __future__ import annotations

import pytest

from tillroll.llm import url_trust as ut

PAGES = "page_id long, url string, html string, trust string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def link(*hosts):
    return "".join(f'<p><a class="x" href="https://{h}/p?q=1">go</a>' for h in hosts)


def test_rules_hosts_and_paths(spark):
    urls = {
        1: ("http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        3: ("https://example.org/en/27#top", "example.org", "/en/27", "org/", "allow"),
        4: ("https://notexample.org", "notexample.org", "", None, "allow"),
        5: ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        6: ("http://y.com/de/?q", "y.com", "/de/", "com/de/", "block"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme/at all", "", "", None, "allow"),
        9: ("http://é.NET?x=://b.org/", "é.net", "", None, "allow"),
        10: ("http://xorg/", "xorg", "/", None, "allow"),
        11: ("ftp://a://b.org/c", "a:", "//b.org/c", None, "allow"),
    }
    got = {r.page_id: r for r in ut.judge_urls(pages(spark, [(i, u[0], None) for i, u in urls.items()])).collect()}
    for i, (_, host, path, rule, verdict) in urls.items():
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), i


def dense(seeds, links, damping, steps=200):
    """Power iteration on dictionaries."""
    out, into = {}, {}
    for (a, b), n in links.items():
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    hosts = set(seeds) | {h for ab in links for h in ab}
    rank = {h: (0.0, 0.0) for h in hosts}
    for _ in range(steps):
        new = {h: [(1 - damping) * x for x in seeds.get(h, (0.0, 0.0))] for h in hosts}
        for (a, b), n in links.items():
            new[b][0] += damping * rank[a][0] * n / out[a]
            new[a][1] += damping * rank[b][1] * n / into[b]
        rank = {h: tuple(v) for h, v in new.items()}
    return rank


def test_propagation_against_dense_iteration(spark):
    links = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 3, ("d", "bad"): 4, ("c", "d"): 1, ("e", "d"): 1}
    seeds = {"a": (10.0, 0.0), "bad": (0.0, 8.0), "alone": (1.0, 2.0)}
    got = ut.propagate(
        spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"),
        spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, links long"),
        tolerance=1e-12,
        most_steps=100,
    )
    expected = dense(seeds, links, ut.DAMPING)
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert set(found) == set(expected)
    for h in expected:
        assert found[h] == pytest.approx(expected[h], abs=1e-6)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    rows = [
        (1, "http://good.org/a", link("friend.net", "good.org")),
        (2, "http://friend.net/", None),
        (3, "http://shop.com/de/1", link("other.net")),
        (4, "http://spam.net/x", link("shop.com", "SHOP.com") + '<a href="/relative">x</a>'),
        (5, "http://shop.com/en/1", ""),
        (6, "http://other.net/", ""),
        (6, "http://other.net/", ""),
    ]
    got = {r.page_id: r.verdict for r in ut.judge_urls(pages(spark, rows)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_distrust_arrives_however_many_hosts_there_are(spark):
    chain = [f"spam{i}" for i in range(33, 0, -1)] + ["bad"]
    seeds = [("bad", 0.0, 100.0)] + [(f"other{i}", 100.0, 0.0) for i in range(2000)]
    got = ut.propagate(
        spark.createDataFrame(seeds, "host string, trust double, distrust double").coalesce(1),
        spark.createDataFrame([(*ab, 1) for ab in zip(chain, chain[1:])], "src string, dst string, links long"),
    )
    found = {r.host: r.distrust for r in got.filter("trust = 0").collect()}
    for hops, host in enumerate(reversed(chain)):
        assert found[host] == pytest.approx((1 - ut.DAMPING) * 100 * ut.DAMPING**hops), host


def test_links_are_summed_per_host_pair(spark):
    rows = [(i, "http://hot.net/", link("a.org", "b.org", "hot.net")) for i in range(50)] + [(99, None, link("a.org"))]
    found = {(r.src, r.dst): r.links for r in ut.host_links(pages(spark, rows)).collect()}
    assert found == {("hot.net", "a.org"): 50, ("hot.net", "b.org"): 50}


def test_empty_table(spark):
    assert ut.judge_urls(pages(spark, [(1, "http://a.b/", "")]).limit(0)).count() == 0
