import random
import re

import numpy as np
import pytest
from venuegrid.llm import jaccard
from venuegrid.llm.components import components
from venuegrid.llm.jaccard import link_counts, linked_texts, local_links, near_duplicates, prefix_plan
from document_tables import docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted((-1 if i is None else i, len(s), -1 if not s and i is None else names.get(find(k), -1)) for k, (i, s) in enumerate(sets))


def result(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng, n_groups=12, group=14):
    rows, passage = [], " ".join(f"p{k}" for k in range(60))
    for _ in range(n_groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(20, 120))]
        rows += [edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5])) for _ in range(group)]
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + " " + passage + " " + str(k) for k in range(25)]
    chain = [f"c{k}" for k in range(140)]
    rows += [" ".join(chain[k : k + 100]) for k in range(0, 40, 5)]
    rows += [rows[0]] * 9 + [rows[0].upper(), "one two", "One  Two\n", "one two three four", "a a a a a a a a", "", None, None, " \t", "x " * 4000, "x " * 5000, "é É", "É é"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("unit, hot", [(jaccard.UNIT_SHINGLES, 1000), (300, 8)])
def test_components_equal_brute_force(spark, docs, unit, hot):
    rng = random.Random(unit)
    rows = corpus(rng) + [(7, "null ids do not name a component"), (None, "null ids do not name a component"), (None, "alone with a null id here")]
    rows += [(9, "a repeated row of some words"), (9, "a repeated row of some words")]
    got = near_duplicates(docs(rows, extra=True).repartition(5), unit=unit, hot_share=0.0, hot_texts=hot)
    assert result(got) == brute(rows)


def test_large_cluster_in_blocks(spark, docs):
    """One group of near copies, far above a unit, some of them linked with few others."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = list(enumerate(edited(rng, base, rng.choice([1, 1, 2, 2, 3])) for _ in range(220)))
    assert result(near_duplicates(docs(rows), unit=500, hot_share=0.0, hot_texts=10)) == brute(rows)


def test_edges(docs):
    assert near_duplicates(docs([])).count() == 0
    assert result(near_duplicates(docs([(1, None), (2, ""), (3, None)]))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_prefixes_ask_for_more_matches_where_lists_are_long():
    rare, common = np.full(80, 2), np.full(80, 5000)
    assert prefix_plan(80, rare)[0] <= prefix_plan(80, common)[0] and prefix_plan(80, common)[0] > 1
    for n in range(1, 60):
        for m in range(jaccard._required(n), n + 1):
            matches, length = prefix_plan(n, np.arange(2, 2 + m))
            assert 1 <= matches <= length <= m and length == n - jaccard._required(n) + matches - (n - m)


def test_local_links_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        base = np.arange(60)
        sets = [np.sort(rng.choice(base, rng.integers(20, 50), replace=False)) for _ in range(30)]
        counts = np.bincount(np.concatenate(sets), minlength=60)
        ranked = [s[np.lexsort((s, counts[s]))] for s in sets]
        plans = [prefix_plan(len(s), counts[s]) for s in ranked]
        sizes = np.array([len(s) for s in sets])
        got = local_links(np.arange(30), sizes, np.array([p[0] for p in plans]), [s[: p[1]] for s, p in zip(ranked, plans, strict=True)], ranked, np.arange(30))
        label = list(range(30))
        for a in range(30):
            for b in range(a):
                x = len(np.intersect1d(sets[a], sets[b]))
                if 100 * x >= 75 * (sizes[a] + sizes[b] - x):
                    label = [label[a] if v == label[b] else v for v in label]
        own = list(range(30))
        for a, b in got:
            own = [own[a] if v == own[b] else v for v in own]
        assert len({*zip(label, own, strict=True)}) == len(set(label)) == len(set(own))


def test_long_chain_of_links(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("unit, hot", [(jaccard.UNIT_SHINGLES, 1000), (300, 8)])
def test_all_links_equal_brute_force(spark, docs, unit, hot):
    rows = corpus(random.Random(unit + 1))
    sets = {i: shingles(t) for i, t in rows}
    words = {i: tuple(WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))) for i, t in rows}
    least = {}
    for i in sorted(words):
        least.setdefault(words[i], i)
    links, pairs = dict.fromkeys(sets, 0), {}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                links[a] += 1
                if least[words[a]] == a and least[words[b]] == b and a < b:
                    pairs[a, b] = len(x & y) / len(x | y)
    found = linked_texts(docs(rows), unit=unit, hot_share=0.0, hot_texts=hot).persist()
    got = {tuple(sorted((r["least_1"], r["least_2"]))): r["jaccard"] for r in found.collect()}
    assert found.count() == len(got) > 100
    assert got == pytest.approx(pairs)
    assert {r["doc_id"]: r["n_links"] for r in link_counts(docs(rows), unit=unit, hot_share=0.0, hot_texts=hot).collect()} == links
    assert linked_texts(docs([])).count() == 0 and link_counts(docs([])).count() == 0
