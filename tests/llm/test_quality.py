import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from venuegrid.llm import quality
from venuegrid.llm.quality import FEATURES, judge_quality, robust_estimates, text_statistics
from document_tables import docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if counts[x] > 1:
            covered.update((k, k + 1, k + 2))
    return (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))


EDGES = [None, "", " \t\n", "a", "a b c", "a b c d a b c", "a a a a a", "x\n\nx\n x\r\nx", "é 😀 #*$%&|<>", "a b " * 3000, "w" * 9000, "l one\nl one\nl one"]


def test_statistics_equal_brute_force(spark, docs):
    rng = random.Random(2)
    texts = EDGES + [" ".join(rng.choices("abcd\n", k=rng.randint(0, 80))) for _ in range(200)]
    got = text_statistics(docs(list(enumerate(texts)), extra=True), "doc_id").collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])


def make(rng, n, word="ab cde fghi jk lmnopq".split()):
    return " ".join("".join(rng.sample(word, 2)) + str(rng.randrange(999)) for _ in range(n))


def test_outliers_go_and_clean_documents_stay(spark, docs):
    rng = random.Random(4)
    rows = [(i, make(rng, rng.randint(60, 300)), "en", rng.choice("st")) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in make(rng, 100).split()), "en", "s") for i in range(12)]
    small = [(2000, make(rng, 80), "xx", None), (2001, None, None, None), (2002, "", "en", "s"), (2003, "word " * 400, "en", "s")]
    got = {r["doc_id"]: r for r in judge_quality(docs(rows + junk + small, extra=True)).collect()}
    assert len(got) == len(rows + junk + small)
    assert all(got[r[0]]["kept"] for r in rows) and not any(got[r[0]]["kept"] for r in junk)
    assert got[2000]["kept"] and got[2000]["distance"] is None
    assert [got[i]["base_failed"] for i in (2001, 2002, 2003)] == [True] * 3
    assert judge_quality(docs([])).count() == 0


def test_each_statistic_can_reject_alone(spark, docs):
    """One planted document for each statistic; it differs from the others in that one."""
    rng = random.Random(6)
    rows = [(i, make(rng, rng.randint(60, 300)), "en", "s") for i in range(300)]
    plain = make(rng, 120).split()
    lines = "\n".join(make(rng, 10) for _ in range(20))
    phrase = make(rng, 22)
    planted = {
        "log_words": make(rng, 60_000),
        "log_word_length": " ".join(w * 4 for w in plain),
        "log_symbols": " ".join(w + "%" * (k % 3) for k, w in enumerate(plain)),
        "dup_line_share": lines + "\n" + "\n".join(["abcd12"] * 45),
        "repeat_share": phrase + " " + make(rng, 40) + " " + phrase + " " + make(rng, 20),
    }
    rows += [(1000 + k, text, "en", "s") for k, text in enumerate(planted.values())]
    got = {r["doc_id"]: r for r in judge_quality(docs(rows)).collect()}
    assert not any(got[1000 + k]["base_failed"] for k in range(len(planted)))
    assert {name: got[1000 + k]["kept"] for k, name in enumerate(planted)} == dict.fromkeys(planted, False)
    assert all(got[k]["kept"] for k in range(300))


def test_estimate_equals_numpy(spark):
    """One concentration step after another, in numpy, from the same two starts."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)) * [1, 0.2, 1, 0.1, 0.2] + 3
    x[:60] += [0, 3, 6, 0, 2]
    names = list(FEATURES)
    rows = spark.createDataFrame([("en", "s", *map(float, v)) for v in x], "g_lang string, g_source string, " + ", ".join(f"{n} double" for n in names))
    got = robust_estimates(rows, min_group=10).where("g_level = 1").collect()[0]
    least = np.array([v**2 for v in FEATURES.values()])

    def floored(cov):
        cov = cov.copy()
        np.fill_diagonal(cov, np.maximum(np.diag(cov), least) + quality.RIDGE * least)
        return cov

    cut = quality._chi_square_upper(0.25, 5)
    scale = 0.75 / quality._chi_square(cut, 7)
    def at(v, share):
        return np.sort(v)[int(np.ceil(share * len(v))) - 1]

    spread = np.array([(at(c, 0.75) - at(c, 0.25)) / 1.349 for c in x.T])
    starts = [(np.array([at(c, 0.5) for c in x.T]), np.diag(np.maximum(spread**2, least))), (x.mean(0), floored(np.cov(x.T, bias=True)))]
    ends = []
    for centre, cov in starts:
        for _ in range(3):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            own = x[d <= at(d, 0.75)]
            centre, cov = own.mean(0), floored(scale * np.cov(own.T, bias=True))
        ends.append((np.linalg.det(cov), centre))
    assert np.allclose([got[f"m_{i}"] for i in range(5)], min(ends, key=lambda e: e[0])[1], atol=1e-6)


def test_no_python_in_the_plan(spark, docs, capsys):
    judge_quality(docs([(1, "a b c", "en", "s")])).where(F.lit(True)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
