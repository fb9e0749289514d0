"""URL filters: the template tree against its SQL form, deep paths, unlabelled hosts."""

import random

import duckdb

from caseflow.llm import url_templates


def judged(spark, urls, rules=url_templates.RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: r for r in url_templates.judge(pages, rules).collect()}


def test_paths_of_six_segments_are_told_apart(spark):
    """No depth is cut: the fifth segment decides, and rule and tree agree on what it says."""
    rules = (("block", "h", "/a/b/c/d/bad/"),)
    # the same deep segments, written with a doubled slash, fit no rule
    urls = ([f"http://h/a/b/c/d/bad/{i}" for i in range(60)] + [f"http://h/a/b/c/d/good/{i}" for i in range(60)]
            + ["http://h//a/b/c/d/bad/x", "http://h//a/b/c/d/good/x"])
    r = judged(spark, urls, rules)
    assert all(r[i].verdict == "block" for i in range(60)) and all(r[i].verdict == "allow" for i in range(60, 120))
    assert r[120].rule is None and r[120].verdict == "block" and r[121].verdict == "allow"


def test_unlabelled_hosts_are_judged_by_other_hosts(spark):
    rules = tuple(("block", f"s{i}.x", "/ads/") for i in range(12)) + (("block", "all.y", "/"),)
    urls = [f"http://s{i}.x/{kind}/{j}/v" for i in range(12) for kind in ("ads", "news") for j in range(8)]
    urls += [f"http://all.y/shop/{j}/v" for j in range(50)]
    start = len(urls)
    urls += [f"http://new.z/{kind}/{j}/v" for k, kind in enumerate(("ads", "news", "shop")) for j in range(8 * k, 8 * k + 8)]
    r = judged(spark, urls, rules)
    verdicts = [r[i].verdict for i in range(start, len(urls))]
    # a host that is blocked as a whole says nothing about its paths
    assert verdicts == ["block"] * 8 + ["allow"] * 16
    assert all(r[i].rule is None for i in range(start, len(urls)))
    assert all(r[i].verdict == ("block" if "/ads/" in urls[i] else "allow") for i in range(start - 50))


def test_similar_branches_merge_and_different_ones_do_not(spark):
    kids = [("a", 40, 20, 20, 0), ("b", 40, 19, 21, 0), ("c", 40, 2, 38, 0), ("d", 40, 0, 0, 40), ("e", 40, 0, 0, 0), ("f", 40, 0, 0, 0)]
    child = spark.createDataFrame([("h", "", n, c, b, a, e, c - e) for n, c, b, a, e in kids] + [("h", "", url_templates.WILD, 9, 5, 4, 0, 9)],
                                  "host string, t string, name string, c long, b long, a long, e long, more long")
    to = {r.name: r.to for r in url_templates.branches(child).collect()}
    assert to == {"a": "/a#b", "b": "/a#b", "c": "/c", "d": "/d", "e": "/e#f", "f": "/e#f", "?*": "/?*"}


def test_equal_to_its_sql_on_odd_and_hot_urls(spark):
    rng = random.Random(5)
    hosts = ["big.example.com", *[f"h{i}.example.{d}" for i in range(10) for d in ("com", "net", "org")], "x.net"]
    segs = ["de", "en", "fr", "es", "*", "~", "a|b", "", "é", "long" * 40]
    urls = [None, "", "no scheme", "://", "http://", "http://big.example.com"]
    for _ in range(2500):
        host = hosts[0] if rng.random() < 0.4 else rng.choice(hosts)
        path = "/".join(rng.choice(segs) if rng.random() < 0.7 else str(rng.randrange(50)) for _ in range(rng.randrange(1, 8)))
        urls.append(f"http://{host}/{path}" + rng.choice(["", "?q=/x", "#f", "/"]))
    urls += ["http://big.example.com/" + "/".join("deep" for _ in range(40))] * 2 + ["http://big.example.com/en/1"] * 900
    pages = spark.createDataFrame([(None if i % 50 == 7 else i, u) for i, u in enumerate(urls)], "page_id long, url string").coalesce(2)
    got = [tuple(r) for r in url_templates.judge(pages).collect()]
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = con.sql("SELECT page_id, host, path, rule, verdict FROM (" + url_templates.oracle() + ")").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(urls)
    assert any(v == "block" and rule is None for *_, rule, v in got)
