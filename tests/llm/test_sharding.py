import random
import zlib

import pytest
from venuegrid.llm.sharding import build_tree, metadata, shard_documents, write_shards
from document_tables import docs  # noqa: F401


@pytest.fixture
def rows():
    rng = random.Random(6)
    out = [(i, "é" * rng.randint(0, 300) + str(i), rng.choice(["en", "fr", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}") for i in range(900)]
    out += [(2000 + i, "copy of a text", "en", "hot") for i in range(400)]
    return out + [(5000, None), (5001, ""), (None, "no id"), (5002, "twice"), (5002, "twice"), (5003, "x" * 9000)]


def check(rows, got, shards):
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_are_near_equal(docs, rows, shards):
    got = shard_documents(docs(rows), shards).collect()
    sizes = check(rows, got, shards)
    mean = sum(sizes) / shards
    assert all(abs(s - mean) <= 9000 if s > 1.1 * mean else abs(s - mean) < 0.2 * mean for s in sizes)


def test_equal_without_giants(docs, rows):
    sizes = check(rows[:-1], shard_documents(docs(rows[:-1], extra=False), 8).collect(), 8)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8 + 1200


def test_edges(docs):
    assert shard_documents(docs([]), 16).count() == 0
    assert sorted(r["slot"] for r in shard_documents(docs([(1, "a")] * 5), 4).collect()) == list(range(5))
    assert {r["shard"] for r in shard_documents(docs([(i, "a" * 100) for i in range(64)], extra=True).drop("size"), target_bytes=1616).collect()} == set(range(4))


def test_written_documents_equal_the_assignment(spark, docs, rows, tmp_path):
    table = docs(rows, extra=True)
    meta = metadata(table)
    tree = build_tree(meta, 4)
    write_shards(table, tree, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(rows) and set(table.columns) < set(got.columns)
    want = {(r["doc_id"], r["text_crc32"], r["shard"]) for r in tree.assign(meta).collect()}
    assert {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard"]) for r in got.collect()} == want
