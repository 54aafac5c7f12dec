import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from venuegrid.llm.queries import URL_RULES
from venuegrid.llm.url_rules import judge_urls, mine_rules, url_items

CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme", "", "", None), ("http://A.Example.ORG", "a.example.org", "", None),
    ("http://x.org/", "x.org", "/", "org/"), ("http://xorg/", "xorg", "/", None), ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/"),
    ("http://m.example.org/en/19?x#y", "m.example.org", "/en/19", "example.org/en/1"), ("http://example.org/en/2", "example.org", "/en/2", "org/"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/"), ("x://a.com/fr/é://b", "a.com", "/fr/é://b", "com/fr/"),
    ("http://a.com/de/\nx", "a.com", "/de/\nx", "com/de/"), ("http://a.com?u=/de/", "a.com", "", None), ("http://a.com#/de/", "a.com", "", None), ("://org/", "org", "/", "org/"),
]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "h", "clash") for i, c in enumerate(CASES)], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    verdicts = {rule: kind for kind, rule in URL_RULES}
    got = {r["page_id"]: r for r in judge_urls(pages, labels, URL_RULES).collect()}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdicts.get(rule, "allow"))
    assert judge_urls(pages.limit(0), labels, URL_RULES).count() == 0


@pytest.fixture
def labelled(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        spam, lang = rng.random() < 0.3, rng.choice(["en", "fr"])
        site = f"{rng.choice(['casino', 'pills'])}-win.net" if spam else f"site{rng.randrange(5)}.net"
        blocked = lang == "en" if spam else rng.random() < 0.02
        rows.append((i, f"https://{rng.choice(['www', 'm'])}.{site}/{lang}/{rng.randrange(99)}?ref=x", blocked))
    return spark.createDataFrame(rows, "page_id long, url string, blocked boolean")


def test_mined_rules_equal_brute_force(spark, labelled):
    rows = [(frozenset(r["i"]), r["blocked"]) for r in labelled.select(url_items(F.col("url")).alias("i"), "blocked").collect()]
    counts = {}
    for items, blocked in rows:
        for k in range(1, len(items) + 1):
            for c in itertools.combinations(sorted(items), k):
                n = counts.setdefault(c, [0, 0])
                n[blocked] += 1
    total = [sum(b == v for _, b in rows) for v in (False, True)]
    rules = {}
    for items, n in counts.items():
        for v in (0, 1):
            c = n[v] / sum(n)
            if n[v] >= 20 and c >= 0.6 and c >= 1.5 * total[v] / len(rows):
                rules[items, "allow block".split()[v]] = (n[v], c)
    # A rule is held against all rules a token less, pruned ones included.
    want = {}
    for (items, v), (n, c) in rules.items():
        parts = [(p, v) for p in itertools.combinations(items, len(items) - 1)]
        if not any(p in rules and rules[p][1] >= c for p in parts):
            want[items, v] = (n, c)
    got = {(tuple(r["items"]), r["verdict"]): (r["support"], r["confidence"]) for r in mine_rules(labelled).collect()}
    assert want and got == want


def test_mined_rules_judge_new_urls(spark, labelled):
    new = [(1, "https://www.casino-win.net/en/7"), (2, "https://www.casino-win.net/fr/7"), (3, "https://site1.net/en/3"), (4, "http://x.org/en/3")]
    pages = labelled.select("page_id", "url").unionByName(spark.createDataFrame([(i + 10_000, u) for i, u in new], "page_id long, url string"))
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages, labelled, URL_RULES).collect()}
    assert [got[10_000 + i] for i, _ in new] == ["block", "allow", "allow", "allow"]
    assert not re.search("Python|Pandas|Arrow", judge_urls(pages, labelled, URL_RULES)._jdf.queryExecution().toString())


@pytest.mark.parametrize("common", ["allow", "block"])
def test_the_common_verdict_has_rules(spark, common):
    """Most URLs of a directory have the rare verdict, those of one site in it never."""
    rows = [(f"http://a{k % 7}.net/{'x' if k < 100 else 'y'}/{k}?n=1", k < 100) for k in range(400)]
    rows += [(f"http://good.net/x/{k}?n=1", False) for k in range(40)]
    labels = spark.createDataFrame([(i, u, rare == (common == "allow")) for i, (u, rare) in enumerate(rows)], "page_id long, url string, blocked boolean")
    new = [(1000, "http://good.net/x/7?n=2"), (1001, "http://a1.net/x/7?n=2"), (1002, "http://a1.net/y/7?n=2")]
    pages = labels.select("page_id", "url").unionByName(spark.createDataFrame(new, "page_id long, url string"))
    got = {r["page_id"]: (r["verdict"], r["by_mined_rule"]) for r in judge_urls(pages, labels, URL_RULES).collect()}
    rare = "block" if common == "allow" else "allow"
    assert [got[i] for i, _ in new] == [(common, True), (rare, True), (common, True)]


def test_a_clear_rule_of_the_rare_verdict_outdoes_a_common_one(spark):
    rows = [(f"https://ok{k % 9}.net/{k}", k % 20 == 0) for k in range(360)] + [(f"http://ok{k % 9}.net/{k}", k % 8 == 0) for k in range(240)]
    rows += [(f"https://bad.net/{k}", k % 10 < 7) for k in range(40)]
    labels = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, blocked boolean")
    pages = spark.createDataFrame([(1000, "https://bad.net/7"), (1001, "https://ok3.net/7")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(labels.select("page_id", "url").unionByName(pages), labels, URL_RULES).collect()}
    assert got[1000] == "block" and got[1001] == "allow"


def test_parameters_that_always_come_together(spark):
    """Thirty tokens with the same baskets are one for the mining; each still fits by itself."""
    names = [f"{chr(97 + k // 5)}{chr(97 + k % 5)}=x" for k in range(31)]
    shared = "&".join(names[:30])
    rows = [(k, f"https://s{k % 5}.net/x/{k}?{shared if k % 3 == 0 else 'q=' + str(k)}", k % 3 == 0) for k in range(90)]
    labels = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    rules = mine_rules(labels, min_count=10, min_gain=0.5)
    found = {(tuple(r["items"]), r["verdict"]): (r["support"], r["confidence"]) for r in rules.collect()}
    assert {items[0] for items, v in found if v == "block"} == {f"query:{name}" for name in names[:30]} and {found[r] for r in found if r[1] == "block"} == {(30, 1.0)}
    new = spark.createDataFrame([(1000, f"https://other.net/?{names[7]}"), (1001, f"https://other.net/?{names[30]}")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(labels.select("page_id", "url").unionByName(new), labels, URL_RULES, min_count=10, min_gain=0.5).collect()}
    assert got[1000] == "block" and got[1001] == "allow" and got[0] == "block" and got[1] == "allow"
