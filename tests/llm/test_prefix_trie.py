"""The prefix trie against a plain one, and the radix tree against a set of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from venuegrid.llm.prefix_trie import WIDTH, conversation_trie, prefix_trie, shared_openings, turn_sequences
from venuegrid.llm.radix_tree import RadixTree

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(out[b][6] for b in below)
        leaves = sum(out[b][5] for b in below) or 1
        ends = sorted(c for c in members[node] if len(convs[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves, saved, digest)
    return sorted(out.values(), key=str)


def answer(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def conversations(seed, n=150, alphabet=3, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(9) if c != 7 or not long else long):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "hé", "hello", "good day", None][:alphabet])))
    return rows


@pytest.mark.parametrize("task_turns", [1, 7, 60, 10**6])
def test_trie_equals_a_plain_one(spark, task_turns):
    rows = conversations(task_turns, long=40)
    df = spark.createDataFrame(rows, SCHEMA)
    nodes, _ = prefix_trie(shared_openings(turn_sequences(df)), task_turns)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    assert sorted((tuple(r[c] for c in columns) for r in nodes.collect()), key=str) == sorted((r[:7] for r in brute(rows)), key=str)


def test_query_equals_a_plain_one(spark):
    rows = conversations(5, n=230, alphabet=5)
    assert answer(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [
        (None, 0, "user", "lost"), (3, None, "user", "first"), (3, 1, None, None), (3, 1, None, None), (3, 2, "user", ""), (100, 0, "user", "x" * 200_000),
        (104, 0, "user", "own"), (104, 1, "user", "more"), (204, 0, "a", "b"), (-7, 0, "user", "ü"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id AS node", "turn AS key", "role AS turns", "text AS parent")
    assert answer(conversation_trie(df)) == brute([r for r in rows if r[0] != -7] + [(-7, 0, "user", "ü")])


def test_empty_table(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_common_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(3000) for t in range(6)]
    got = answer(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 7


def test_radix_tree_layouts_and_aligned_depths():
    rng = random.Random(1)
    keys = {bytes(rng.randrange(256) if k % 3 == 0 else rng.randrange(2) for k in range(3 * n)) for n in range(1, 4) for _ in range(400)}
    tree = RadixTree(3)
    for key in keys:
        tree.insert(key, key)
    seen = {}
    for entered, depth, digest, symbol, value in tree.walk():
        if entered:
            assert digest not in seen
            seen[digest] = depth, symbol, value
    want = {}
    for key in keys | {b""}:
        for d in range(0, len(key) + 1, 3):
            prefix = key[:d]
            want[hashlib.md5(prefix).digest()] = d // 3, prefix[-3:], prefix if prefix in keys else None
    assert seen == want
    assert all(tree.layouts()[size] for size in (4, 256))


def test_radix_tree_grows_through_all_layouts():
    for n, layout in ((4, 4), (5, 16), (17, 48), (49, 256)):
        tree = RadixTree(1)
        for b in random.Random(n).sample(range(256), n):
            tree.insert(bytes([b]), b)
        assert tree.root.layout == layout
        assert [b for b, _ in tree.root] == sorted(b for b, _ in tree.root) and len(list(tree.root)) == n
    with pytest.raises(ValueError):
        RadixTree(WIDTH).insert(b"short", 1)
