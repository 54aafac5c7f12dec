import random
import zlib
from collections import Counter

import pytest
from venuegrid.llm.language import UNKNOWN, feature_counts, identify, train
from document_tables import docs  # noqa: F401

SYLLABLES = {"en": "the ing and wh sh ly", "de": "sch ein ung ö pf keit", "fr": "eau oi que é ç ment", "es": "ción os ñ ll ía rr", "xx": "zzq kwa vv"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(500):
        lang = rng.choice(list(SYLLABLES))
        word = lambda: "".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3)))  # noqa: B023, E731
        out.append((i, " ".join(word() for _ in range(rng.randint(4, 60))), lang if rng.random() < 0.9 else None, lang))
    return out


def test_held_out_accuracy(docs, rows):
    edges = [(1000, None, "en"), (1001, "", "en"), (1002, "12 ² ½ _ !?", "de"), (1003, "the " * 30_000, "en"), (1003, "the " * 30_000, "en"), (None, "que eau", "fr"), (1004, "x", "rare")]
    got = identify(docs(rows + edges, extra=True)).collect()
    assert len(got) == len(rows) + len(edges)
    truth = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {*SYLLABLES, UNKNOWN}
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)] == [UNKNOWN] * 3
    assert [r["lang_pred"] for r in got if r["doc_id"] == 1003] == ["en"] * 2


def test_features_are_counts_of_letter_runs():
    """Equal runs are one feature, and their numbers are those of a plain loop."""
    text = "Ab, ab2ÉB  xyz"
    runs = Counter()
    for word in ["ab", "ab", "éb", "xyz"]:
        marked = f" {word} "
        runs.update(word)
        runs.update(marked[i : i + 2] for i in range(len(marked) - 1))
        runs.update(marked[i : i + 3] for i in range(len(marked) - 2))
    counts = feature_counts(text)
    assert counts.sum() == sum(runs.values())
    assert sorted(counts[counts > 0]) == sorted(runs.values())
    assert feature_counts("12 ½² _!").sum() == 0 and feature_counts("𝒜 日").sum() == 8


def test_families_come_first(docs, rows):
    model = train(docs(rows))
    assert len(model.families) == 3 and model.pairs == [("de", "en"), ("es", "fr")]


def test_nothing_to_learn(docs):
    assert identify(docs([])).count() == 0
    assert [r["lang_pred"] for r in identify(docs([(1, "a b", None), (2, "c", "en")])).collect()] == [UNKNOWN] * 2
