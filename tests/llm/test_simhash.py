"""SimHash groups against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from document_tables import docs  # noqa: F401
from venuegrid.llm.common import Scratch
from venuegrid.llm.components import components
from venuegrid.llm.simhash import NEAR, band_masks, fingerprint, near_links, pivot_links, reference_fingerprints, simhash_groups


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps, near=NEAR):
    """Component of each different fingerprint, by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= near:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def plain(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_roots(fps)
    least = {}
    for (doc, *_), f in zip(rows, fps, strict=True):
        if doc is not None:
            least[roots[f]] = min(doc, least.get(roots[f], doc))
    return sorted(((doc, f"{f:016x}", least.get(roots[f])) for (doc, *_), f in zip(rows, fps, strict=True)), key=str)


def answer(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_fingerprint_equals_the_plain_one_and_the_hash_of_spark(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "ÄB c", "a b c d", "Ünï x y z w v", *[" ".join(rng.choice(["the", "A", "of", "ß", "x\ty"]) for _ in range(n)) for n in (3, 4, 5, 50, 700)]]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    row = spark.createDataFrame([("ünï a b c",)], "s string").select(F.xxhash64("s")).first()
    assert row[0] % (1 << 64) == fingerprint("ünï a b c")
    assert fingerprint("a b c d " * 40_000) == plain_fingerprint("a b c d " * 40_000)


def test_references_and_tables():
    words = reference_fingerprints()
    assert all((int(a) ^ int(b)).bit_count() == 32 for i, a in enumerate(words) for b in words[:i])
    for n, tables in ((10, 5), (10**6, 15), (10**9, 35), (10**11, 70)):
        masks = band_masks(n)
        assert len(masks) == tables and len({m.bit_count() for m in masks}) <= tables
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), NEAR):
            b ^= 1 << bit
        assert any(a & m == b & m for m in band_masks(10**6))


def clusters(seed, n=900, spread=3):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        out.append(centre)
        for _ in range(n // 12):
            f = rng.choice(out[-20:])
            for bit in rng.sample(range(64), rng.randrange(1, spread + 5)):
                f ^= 1 << bit
            out.append(f)
    return out


@pytest.mark.parametrize("spread", [1, 3, 6])
def test_pivot_links_connect_what_all_pairs_connect(spread):
    fps = sorted(set(clusters(spread, spread=spread)))
    a, b = pivot_links(np.array(fps, np.uint64), np.zeros(len(fps), np.int64))
    assert all((int(x) ^ int(y)).bit_count() <= NEAR for x, y in zip(a, b, strict=True))
    linked = plain_roots(fps)
    got = {f: f for f in fps}

    def find(f):
        while got[f] != f:
            f = got[f]
        return f

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = sorted((find(x), find(y)))
        got[y] = x
    assert len({find(f) for f in fps}) == len(set(linked.values()))
    assert len(a) < len(fps)


@pytest.mark.parametrize(("run", "block"), [(4096, 8192), (3, 8), (20, 30)])
def test_runs_and_blocks_of_any_size(spark, run, block):
    """Fingerprints with a common half, so that tables have long runs."""
    rng = random.Random(block)
    fps = {f & ~0xFFFFFFFF | rng.getrandbits(8) for f in clusters(8, 400)} | set(clusters(9, 200))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    scratch = Scratch(spark, "test")
    nodes = spark.createDataFrame(signed, "fp long")
    found = components(near_links(nodes, NEAR, run, block, scratch)).collect()
    classes = {r["node"] % (1 << 64): r["component"] for r in found}
    want = plain_roots(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(classes.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_groups_of_texts(docs):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        text = [rng.choice(words) for _ in range(120)]
        for copy in range(rng.randrange(1, 6)):
            rows.append((len(rows) * 3 % 211 + copy, " ".join(text)))
            text[rng.randrange(120)] = "edit"
    rows += [(500, None), (501, ""), (400, "\n\t"), (77, "short text"), (77, "short text"), (None, "short text"), (None, "lonely here"), (9, "Short TEXT"), (600, "x " * 300_000)]
    assert answer(simhash_groups(docs(rows, extra=True))) == plain(rows)


def test_one_large_group(docs):
    rng = random.Random(5)
    text = [f"w{k}" for k in range(400)]
    rows = [(k, "same words here again and again") for k in range(800)]
    for k in range(800, 1500):
        text[rng.randrange(400)] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(text)))
    assert answer(simhash_groups(docs(rows), run=50, block=100)) == plain(rows)


def test_empty_table(docs):
    assert simhash_groups(docs([])).count() == 0
