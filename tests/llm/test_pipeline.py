import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from venuegrid.llm import common
from venuegrid.llm.common import lean, only, row_key, without
from venuegrid.llm.decontamination import decontaminate
from venuegrid.llm.jaccard import keep_first
from venuegrid.llm.quality import keep_good

import corpus_pipeline
from test_jaccard import brute, edited
from test_quality import make
from test_secrets import brute as base_spans
from test_tokens import check_pieces, truth
from document_tables import docs  # noqa: F401


@pytest.fixture
def folder(spark, docs, tmp_path):
    rng = random.Random(12)
    clean = [make(rng, rng.randint(60, 200)) for _ in range(150)]
    item = " ".join(f"question{k} part{k}" for k in range(12))
    rows = {
        "clean": clean,
        "near": [edited(rng, clean[0].split(), 2) for _ in range(6)] + [clean[1]] * 3,
        "leak": [make(rng, 60) + " " + item + " " + make(rng, 30)],
        "secret": [make(rng, 70) + " password=abcdef12 " + make(rng, 20), make(rng, 70) + " AKIA" + "Q" * 16],
        "junk": ["too short", None, "", " ".join(w + "%%%" for w in make(rng, 90).split()), "again " * 300],
    }
    kind = {}
    table = []
    for name, texts in rows.items():
        for text in texts:
            kind[len(table)] = name
            table.append((len(table), text, "en", "s"))
    docs(table).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), table, kind


def expected(table, kind):
    kept = [(i, t) for i, t, *_ in table if kind[i] != "junk"]
    first = {i for i, _, c in brute(kept) if i == c}
    out = {}
    for i, text in kept:
        if i in first and kind[i] != "leak":
            for _, a, b in reversed(base_spans(text)):
                text = text[:a] + "[SECRET]" + text[b:]
            out[i] = truth(text)
    return out


def test_pipeline_equals_its_stages_by_brute_force(spark, folder):
    path, table, kind = folder
    got = corpus_pipeline.run(spark, path).collect()
    want = expected(table, kind)
    assert {kind[i] for i in want} == {"clean", "secret"} and len(want) > 140
    check_pieces(got, want)


def test_stages_return_the_documents_columns(spark, folder):
    path, table, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_one_of_each_group_stays(docs):
    text = "one two three four five six seven eight"
    rows = [(5, text), (5, text), (5, "another text of more words"), (3, text.upper()), (None, text), (None, "ten words that are only here"), (8, None), (8, ""), (9, "another text of more words")]
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in keep_first(docs(rows, extra=True)).collect())
    assert got == sorted([(3, text.upper()), (5, "another text of more words"), (-1, "ten words that are only here"), (8, ""), (8, "")])


def test_rows_without_a_word_stay_however_often_they_are_there(docs):
    rows = [(1, ""), (1, ""), (2, "a b c"), (2, "a b c"), (2, "a b c"), (3, None), (3, None), (4, " "), (4, " "), (2, "other words here"), (1, "A b C")]
    got = sorted((r["doc_id"], r["text"] or "") for r in keep_first(docs(rows, extra=True)).collect())
    assert got == sorted([(1, ""), (1, ""), (1, "A b C"), (3, ""), (3, ""), (4, " "), (4, " "), (2, "other words here")])


def test_stages_bear_columns_of_any_name(spark, docs):
    rng = random.Random(3)
    item = " ".join(f"question{k} part{k}" for k in range(12))
    rows = [(k, make(rng, 90), "en", "s") for k in range(80)] + [(80, make(rng, 60) + " " + item, "en", "s"), (81, "junk", "en", "s")]
    table = docs(rows, extra=True)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for stage, gone in ((keep_good, {81}), (keep_first, set()), (lambda t: decontaminate(t, items), {80})):
        kept = stage(table)
        assert kept.columns == table.columns
        assert {r["doc_id"] for r in kept.collect()} == set(range(82)) - gone


def test_rows_are_removed_by_id_and_hash_with_and_without_the_map(docs, monkeypatch):
    rows = [(k % 50, None if k % 7 == 0 else f"text {k % 20}", None if k % 3 else "en") for k in range(400)] + [(None, None), (None, "text 1")]
    table = docs(rows)
    key = table.select(F.col("doc_id"), row_key("text", "lang").alias("hash"), "text", "lang")
    named = key.where("doc_id % 5 = 0 AND text IS NULL OR doc_id IS NULL OR text = 'text 3'").select("doc_id", "hash").distinct()
    rows = [(*r, None)[:3] for r in rows]
    gone = [r for r in rows if r[0] is None or r[0] % 5 == 0 and r[1] is None or r[1] == "text 3"]
    for size in (1 << 18, 1 << 6, 0):
        monkeypatch.setattr(common, "MAP_WORDS", max(size, 1))
        if not size:
            monkeypatch.setattr(type(named), "count", lambda self: 1 << 30)
        pairs = lambda df: Counter((r["doc_id"], r["text"], r["lang"]) for r in df.collect())
        assert pairs(only(table, named, "text", "lang")) == Counter(gone)
        assert pairs(without(table, named, "text", "lang")) == Counter(rows) - Counter(gone)


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_crc_is_unsigned():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) > 0


def _resident() -> int:
    """Bytes of this process that are in memory."""
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_a_task_hands_freed_memory_back():
    def run(batches):
        held = [np.ones(4_000) for _ in range(8_000)]
        pins.append(held[::400])
        del held
        sizes.append(_resident())
        yield from batches

    pins, sizes = [], []
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert sizes[0] - _resident() > 100 << 20
