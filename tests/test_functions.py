import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from venuegrid.functions import display, numbers, ratio, text
from venuegrid.functions.rules import Rule
from venuegrid.operators import quality


def values(spark, texts, *columns, kind="string"):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"i int, t {kind}").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    out = [tuple(r)[1:] for r in df.orderBy("i").collect()]
    return [r[0] for r in out] if len(columns) == 1 else out


def test_match_key(spark):
    cases = {
        "Warung": "",
        "Warung Bu Ani": "bu ani",
        "  RUMAH   MAKAN Sederhana ": "sederhana",
        "Rumah - Makan X": "rumah makan x",
        "rumah\tmakan x": "x",
        "Café Dépôt": "café dépôt",
        "CAFÉ cafe rm depot kedai restoran": "café",
        "Armada rm. Hall": "armada hall",
        "https://maps.app/x-y?q='1'": "https//mapsapp/xyq=1",
        "warungku cafe2": "warungku cafe2",
        "": "",
    }
    assert values(spark, list(cases), text.match_key("t")) == list(cases.values())
    assert values(spark, [None], text.match_key("t")) == [""]


def test_canonical_type_and_strip(spark):
    cases = {"indoor dan OUTDOOR ": "Indoor dan Outdoor", "mix warung & CAFE": "Mix Warung & Cafe", " Bar\n": "Bar"}
    assert values(spark, list(cases), text.canonical_type("t")) == list(cases.values())
    assert values(spark, [None], text.canonical_type("t")) == [None]


def test_clean_text(spark):
    cases = {" a  b\tc ": "a b c", "Rp 10.000,- (é) #1*": "Rp 10.000,- (é) 1", "x_y@z": "x_yz"}
    assert values(spark, [*cases, None], text.clean_text("t")) == [*cases.values(), ""]


def test_contains_is_literal_unless_regex(spark):
    texts = ["a.b", "axb", "A.B(", None]
    assert values(spark, texts, text.contains_text("t", "a.b")) == [True, False, True, False]
    assert values(spark, texts, text.contains_text("t", "a.b", regex=True)) == [True, True, True, False]
    assert values(spark, texts, text.contains_text("t", "(")) == [False, False, True, False]
    assert values(spark, ["Premium", "x"], text.in_text_list("t", " ekonomis , PREMIUM")) == [True, False]


def test_to_number(spark):
    texts = ["12", " 12 ", "1,000", "abc", "", "nan", "inf", "1d", "1.5f", "-2e3", ".5", "5.", None]
    assert values(spark, texts, numbers.to_number("t")) == [
        12.0, 12.0, None, None, None, None, float("inf"), None, None, -2000.0, 0.5, 5.0, None,
    ]


def test_currency(spark):
    amounts = [999.0, 1000.0, 12500.0, 999999.0, 1000000.0, 2550000.0, 0.0, None, float("nan")]
    assert values(spark, amounts, display.format_currency("t"), kind="double") == [
        "Rp 999", "Rp 1K", "Rp 12K", "Rp 1000K", "Rp 1.0M", "Rp 2.6M", "Rp 0", "N/A", "N/A",
    ]
    assert values(spark, [1234567.5, None], display.format_currency("t", "USD"), kind="double") == ["USD 1,234,567.50", "N/A"]


def test_distance_and_rating(spark):
    assert values(spark, [0.25, 0.95, 1.0, 12.34, None], display.format_distance("t"), kind="double") == [
        "250 m", "950 m", "1.0 km", "12.3 km", "N/A",
    ]
    assert values(spark, [0.5], display.format_distance("t", "mi"), kind="double") == ["0.5 mi"]
    assert values(spark, [4.5, 5.5, -1.0, 3.2, None], display.format_rating("t"), kind="double") == [
        "4.5/5 ★★★★☆", "5.0/5 ★★★★★", "0.0/5 ☆☆☆☆☆", "3.2/5 ★★★☆☆", "N/A",
    ]


def test_bands(spark):
    assert values(spark, [25000.0, 25001.0, 100000.0, 100001.0, None], numbers.price_band("t"), kind="double") == [
        "Budget", "Moderate", "Expensive", "Premium", "Unknown",
    ]
    assert values(spark, [1.0, 3.0, 5.0, 10.0, 11.0], numbers.distance_band("t"), kind="double") == [
        "Very Close", "Close", "Moderate", "Far", "Very Far",
    ]
    assert values(spark, [4.5, 4.0, 3.5, 3.0, 2.0, 1.9], numbers.rating_band("t"), kind="double") == [
        "Excellent", "Very Good", "Good", "Average", "Below Average", "Poor",
    ]
    assert values(spark, [0.5, 0.51, 0.3], numbers.silhouette_band("t"), kind="double") == ["Fair", "Good", "Poor"]


def test_safe_math(spark):
    assert values(spark, [0.0, 2.0, None], numbers.safe_divide(F.lit(6), "t"), kind="double") == [0.0, 3.0, 0.0]
    scaled = numbers.normalise("t", F.lit(0), F.lit(10))
    assert values(spark, [-5.0, 5.0, 20.0, None], scaled, kind="double") == [0.0, 0.5, 1.0, 0.0]
    assert values(spark, [3.0], numbers.normalise("t", F.lit(3), F.lit(3)), kind="double") == [0.5]


def test_rules(spark):
    df = spark.createDataFrame(
        [(5, "12", "abcd", [1]), (None, "x", "", []), (99, "-1", "zz", [1, 2, 3]), (7, None, "abc", None)],
        "n int, f string, s string, l array<int>",
    )
    rules = [
        Rule("n", "int", required=True, min_value=6, max_value=50),
        Rule("f", "float", min_value=0),
        Rule("s", "string", min_length=3, pattern="ab"),
        Rule("l", "list", min_length=1, max_length=2),
    ]
    got = [r["violations"] for r in quality.check_rules(df, rules).collect()]
    assert got == [
        ["n: Value must be at least 6"],
        ["n: Value is required", "f: Invalid float value", "l: List must have at least 1 items"],
        ["n: Value must be at most 50", "f: Value must be at least 0", "s: String must be at least 3 characters",
         "l: List must have at most 2 items"],
        [],
    ]
    counts = {r["violation"]: r["rows"] for r in quality.rule_counts(df, rules).collect()}
    assert counts["n: Value is required"] == 1 and len(counts) == 8


WORD = st.text(alphabet="abcd ", max_size=24)


@settings(max_examples=300, deadline=None)
@given(WORD, WORD, st.sampled_from([0.0, 0.4, 0.6, 0.85]))
def test_scorer_equals_the_plain_ratio(a, b, floor):
    plain = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    want = plain if plain >= floor else None
    assert ratio.Scorer().score(a, b, floor) == want


def test_scorer_on_long_and_swapped_texts():
    rng = random.Random(3)
    scorer = ratio.Scorer()
    for _ in range(60):
        a = "".join(rng.choice("abcdefgh ,.") for _ in range(rng.randint(150, 320)))
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            b[rng.randrange(len(b))] = rng.choice("xyz Q1")
        b = "".join(b)
        assert scorer.score(a, b, 0.0) == SequenceMatcher(None, a, b).ratio()
        assert scorer.score(b, a, 0.0) == SequenceMatcher(None, b, a).ratio()
        assert SequenceMatcher(None, a, a).ratio() == 1.0


@pytest.mark.parametrize("floor", [0.0, 0.7])
def test_similarity_columns(spark, floor):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "x"), ("same", "same"), ("abxcd", "abcd")], "a string, b string")
    both = ratio.similarity_both_ways("a", "b", F.lit(floor))
    one = ratio.similarity_from("a", "b", F.lit(floor))
    for r in df.select("a", "b", one.alias("one"), both.alias("both")).collect():
        s = SequenceMatcher(None, r.a, r.b).ratio() if r.a and r.b else 0.0
        assert r.one == (s if s >= floor else None)
        if r.a and r.b:
            assert r.both.forward == r.one


def test_texts_score_many_pairs_at_once():
    rng = random.Random(5)
    texts = ["", "a", "ab" * 40, "ab" * 110, "ß€x" * 30, "x" * 199]
    texts += ["".join(rng.choice("abcd .é") for _ in range(rng.randint(1, 90))) for _ in range(40)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(len(texts))]
    left, right = (pd.Series([texts[p[k]] for p in pairs]) for k in (0, 1))
    for floor in (0.0, 0.4, 0.85):
        got = ratio._score_batch(left, right, pd.Series([floor] * len(pairs)))
        for a, b, value in zip(left, right, got.tolist(), strict=True):
            plain = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            assert value == plain if plain >= floor else math.isnan(value)


def test_a_batch_is_scored_without_a_loop_over_its_pairs(monkeypatch):
    monkeypatch.setattr(ratio.Scorer, "ratio", None)
    texts = [f"http://www.example.org/en/{i}" for i in range(200)]
    left, right = pd.Series(texts * 200), pd.Series([t for t in texts for _ in range(200)])
    both = ratio._score_both_batch(left, right, pd.Series([0.85] * len(left)))
    assert (both.forward[left == right] == 1.0).all() and both.backward.notna().any()


def test_both_orders_are_scored_at_once():
    """They are followed together as long as only one longest block can be chosen."""
    rng = random.Random(8)
    texts = ["", "a", "abab", "baba", "ab" * 40, "x" * 199, "ab" * 110]
    texts += ["".join(rng.choice("ab /1é") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts += [f"http//www{rng.choice(['abba', 'baab', 'cab'])}.examplecom/en/{rng.randrange(300)}" for _ in range(30)]
    scored = ratio.Texts(texts)
    a, b = (x.ravel() for x in np.divmod(np.arange(len(texts) ** 2), len(texts)))
    plain = np.array([SequenceMatcher(None, texts[i], texts[j]).ratio() if texts[i] and texts[j] else 0.0 for i, j in zip(a, b, strict=True)])
    back = plain.reshape(len(texts), -1).T.ravel()
    assert (plain != back).any()
    for floor in (0.0, 0.4, 0.85):
        straight, swapped = scored.ratios_both_ways(a, b, np.full(len(a), floor))
        for got, want in ((straight, plain), (swapped, back)):
            assert np.array_equal(got, np.where(want >= floor, want, np.nan), equal_nan=True)
