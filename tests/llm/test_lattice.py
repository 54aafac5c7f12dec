import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from venuegrid.llm.lattice import MARK, Lattice, score_documents, vocabulary
from document_tables import docs  # noqa: F401

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def segmentations(word, pieces):
    """Every way to spell a word, as lists of pieces; a lone unknown character is None."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        head = word[:n] if word[:n] in pieces else None
        if head or n == 1:
            out += [[head, *rest] for rest in segmentations(word[n:], pieces)]
    return out


def test_recursions_equal_enumeration():
    rng = random.Random(3)
    pieces = [MARK, "a", "b", "ab", "ba", MARK + "a", "aba", "bb"]
    lattice, scores = Lattice(pieces), np.log(np.random.default_rng(0).dirichlet(np.ones(9)))
    value = {p: s for p, s in zip([*pieces, None], scores, strict=True)}
    words = ["".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(60)] + ["é😀"]
    counts = np.arange(1, len(words) + 1)
    got, expected = lattice.log_likelihood(words, scores), np.zeros(9)
    for word, n, log in zip(words, counts, got, strict=True):
        ways = segmentations(MARK + word, set(pieces))
        chances = [math.exp(sum(value[p] for p in way)) for way in ways]
        assert abs(math.log(sum(chances)) - log) < 1e-9
        for way, c in zip(ways, chances, strict=True):
            for p in way:
                expected[8 if p is None else pieces.index(p)] += n * c / sum(chances)
    assert np.allclose(lattice.expected(words, counts, scores), expected)


def test_long_words():
    pieces, scores = vocabulary(PATH)
    lattice = Lattice(pieces)
    assert np.isfinite(lattice.log_likelihood(["x" * 5000, "日" * 70, "a"], scores)).all()


def test_scores(spark, docs):
    rng = random.Random(1)
    syllables = "the ing and wh sh ly é on".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "UPPER upper É é\x0bx\x1cy z"), (203, "unseen"), (204, "w" * 3000), (205, "the the"), (205, "the the"), (None, "a b")]
    rows += [(300 + i, "qzxv jkw" if i % 2 else "the and") for i in range(40)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = score_documents(docs(rows, extra=True).repartition(3), ~held, PATH).collect()
    assert len(got) == len(rows)
    tokens = [[*WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")), None] for _, t in rows]
    taught = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    counts = Counter(x for t, own in zip(tokens, taught, strict=True) if own for x in t)
    n, v = sum(counts.values()), len(counts)
    want = {i: (not own, len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for (i, _), t, own in zip(rows, tokens, taught, strict=True)}
    for r in got:
        held_out, n_tokens, n_known, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out, n_tokens, n_known, n)
        assert abs(r["base_score"] - base) < 1e-6 and math.isfinite(r["score"]) and r["score"] < 0
    score = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    assert score[205] > score[203] > score[204]
    # The scores are those of the model that the learning documents give.
    pieces, start = vocabulary(PATH)
    lattice = Lattice(pieces)
    known = [x for x in counts if x is not None]
    weights = np.exp(start) + lattice.expected(known, np.array([counts[x] for x in known]), start)
    scores, end = np.log(weights / weights.sum()), (counts[None] + 1) / (n + 2)
    for (i, _), t in zip(rows, tokens, strict=True):
        log = lattice.log_likelihood(t[:-1], scores).sum() + (len(t) - 1) * math.log(1 - end) + math.log(end)
        assert abs(log / math.log(10) - score[i] * len(t)) < 1e-6


def test_empty_and_untaught(docs):
    assert score_documents(docs([]), F.lit(True), PATH).count() == 0
    row = score_documents(docs([(1, "a")]), F.lit(False), PATH).collect()[0]
    assert (row["n_known"], row["train_tokens"]) == (0, 0) and row["held_out"]
