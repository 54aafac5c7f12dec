import random
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from venuegrid.functions import signature as signature_module
from venuegrid.functions.text import match_key
from venuegrid.operators import duplicates, key_blocks, text_join
from venuegrid.operators.duplicates import Limits
from venuegrid.operators.components import component_labels
from venuegrid.operators.survivors import removed_ids

SCHEMA = "place_id long, name string, location string, rating double"


def sim(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def is_pair(a, b, t):
    n, loc = sim(a[1], b[1]), sim(a[2], b[2])
    return (n >= t and loc >= 0.6) or (loc >= t and n >= 0.6) or (n >= 0.9 and loc >= 0.4)


def keyed(df):
    rows = df.select("place_id", match_key("name").alias("n"), match_key("location").alias("l"), "rating")
    return [tuple(r) for r in rows.orderBy("place_id").collect()]


def unique(rows):
    seen, out = set(), []
    for r in rows:
        if r[1:3] not in seen:
            seen.add(r[1:3])
            out.append(r)
    return out


def brute(rows, t=0.85):
    return {(a[0], b[0]): (sim(a[1], b[1]), sim(a[2], b[2])) for a, b in combinations(rows, 2) if is_pair(a, b, t)}


def greedy(pairs, rating):
    gone = set()
    for i, j in sorted(pairs):
        if i not in gone and j not in gone:
            gone.add(i if rating[j] > rating[i] else j)
    return gone


def variants(rng, count, bases):
    """Names and addresses that share stems, with edits, copies and empties."""
    rows = []
    for i in range(count):
        name = rng.choice(bases)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            p = rng.randrange(len(name) + 1)
            name = name[:p] + rng.choice(["", "x", "o ", "ñ", "7"]) + name[p + rng.choice([0, 1]) :]
        place = f"jl {rng.choice(['mawar', 'melati', 'anggrek raya'])} no {rng.randrange(12)} kota"
        if rng.random() < 0.2:
            place = f"https://maps.example/{rng.randrange(16**5):05x}?g=1"
        if rng.random() < 0.04:
            name = rng.choice(["", "Warung", "a", "ab", "abc"])
        rows.append((i * 3 + 1, name, place, float(rng.randrange(1, 6))))
    rng.shuffle(rows)
    return rows


BASES = ["Soto Banjar Ibu Ani", "Soto Lamongan Cak Har", "Kopi Kenangan Senja", "Bakso", "Nasi Kuning Cempaka Putih"]


@pytest.mark.parametrize("seed,limits", [(1, Limits()), (2, Limits(4, 7)), (3, Limits(1, 2))])
def test_pairs_equal_brute_force(spark, seed, limits):
    df = spark.createDataFrame(variants(random.Random(seed), 130, BASES), SCHEMA).repartition(5)
    got = duplicates.find_duplicates(df, limits=limits).collect()
    want = brute(unique(keyed(df)))
    assert len(got) == len(want) > 50
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95])
def test_other_thresholds(spark, threshold):
    df = spark.createDataFrame(variants(random.Random(7), 90, BASES), SCHEMA)
    got = duplicates.find_duplicates(df, threshold).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == brute(unique(keyed(df)), threshold)


@pytest.mark.parametrize("threshold", [0.72, 0.81, 0.85, 0.9])
def test_candidates_of_short_texts_are_complete(spark, threshold):
    rng = random.Random(11)
    texts = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).strip() for _ in range(260)} - {""})
    df = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    got = {tuple(r) for r in text_join.candidate_texts(df, threshold, list_rows=25).collect()}
    want = {
        (i, j)
        for (i, a), (j, b) in combinations(enumerate(texts), 2)
        if max(sim(a, b), sim(b, a)) >= threshold
    }
    assert want <= got


def test_a_third_of_all_rows_share_one_name(spark):
    rng = random.Random(5)
    rows = [(i, "Kopi Kenangan", f"jalan {rng.randrange(10**6)} blok {rng.choice('abcdefgh')}", 1.0 + i % 5) for i in range(40)]
    rows += [(100 + i, f"Toko {rng.randrange(10**9)} {rng.randrange(10**9)}", f"gang {rng.randrange(10**9)}", 3.0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(keyed(df))
    got = duplicates.find_duplicates(df, limits=Limits(6, 10)).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want
    kept, _ = duplicates.remove_duplicates(df, limits=Limits(6, 10))
    assert {r["place_id"] for r in kept.collect()} == {r[0] for r in rows} - greedy(want, {r[0]: r[3] for r in rows})


@pytest.mark.parametrize("ends", [[], [40], [4, 30, 31, 200], [100000]])
def test_waves_do_not_change_the_outcome(spark, ends):
    df = spark.createDataFrame(variants(random.Random(21), 110, BASES), SCHEMA)
    rows = unique(keyed(df))
    keys = duplicates.match_keys(df, "name", "location", "place_id", "rating").withColumn("copies", F.lit(1))
    keys = keys.where("name <> '' and location <> ''").persist()
    gone = duplicates.removed_keys(keys, limits=Limits(5, 10), ends=ends)
    assert sorted(r["id"] for r in gone.collect()) == sorted(greedy(brute(rows), {r[0]: r[3] for r in rows}))


def test_copies_are_counted_but_not_paired(spark):
    rng = random.Random(9)
    rows = variants(rng, 60, BASES[:3])
    rows += [(1000 + 7 * i, *rng.choice(rows)[1:3], 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    all_rows = keyed(df)
    assert duplicates.count_duplicates(df).first()[0] == len(brute(all_rows))
    report = duplicates.duplicate_report(df)
    firsts = unique(all_rows)
    named = [r for r in all_rows if r[1] and r[2]]
    assert report.where("kind = 'copy'").count() == len(named) - len(unique(named))
    assert report.where("kind = 'similar'").count() == len(brute(firsts))
    one = report.where("kind = 'similar'").first()
    assert one["name_similarity"] == round(one["name_similarity"], 3) and one["id_1"] < one["id_2"]


def test_pairs_of_keys_stand_for_all_pairs_of_rows(spark):
    rng = random.Random(9)
    rows = variants(rng, 60, BASES[:3])
    rows += [(1000 + 7 * i, *rng.choice(rows)[1:3], 2.0) for i in range(60)]
    pool = keyed(spark.createDataFrame(variants(random.Random(3), 250, BASES), SCHEMA))
    one_way = next((a, b) for a, b in combinations(pool, 2) if is_pair(b, a, 0.85) != is_pair(a, b, 0.85))
    one_way = one_way if is_pair(*one_way[::-1], 0.85) else one_way[::-1]
    rows += [(5000 + i, *one_way[k][1:3], 2.0) for i, k in enumerate([0, 1, 0, 1, 0])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(keyed(df))
    keys = duplicates.duplicate_keys(df, limits=Limits(4, 7)).persist()
    count = duplicates.count_duplicates(df).first()[0]
    report = duplicates.duplicate_report(df).persist()
    assert count == len(want) == report.agg(F.sum("row_pairs")).first()[0]
    assert report.where("kind = 'similar copies' AND id_1 = 5000 AND id_2 = 5001").first()["row_pairs"] == 3
    texts = {r[0]: r[1:3] for r in keyed(df)}
    got = {(r[0], r[1]): (r[2], r[3]) for r in duplicates.expand_pairs(df, keys).collect()}
    assert got == {p: s for p, s in want.items() if texts[p[0]] != texts[p[1]]}
    assert keys.agg(F.sum("row_pairs")).first()[0] == len(got)


def test_exact_dedupe_keeps_the_first(spark):
    rows = [(5, "Warung A", "x", 3.0), (2, "a", "X ", 5.0), (9, "A.", "x", 4.0), (4, "a", "y", 1.0), (7, None, None, 1.0), (8, "", "", 2.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in duplicates.exact_dedupe(df).collect()) == [
        (2, "a", "X ", 5.0), (4, "a", "y", 1.0), (7, None, None, 1.0),
    ]


def test_removal_counts(spark):
    df = spark.createDataFrame(variants(random.Random(4), 100, BASES), SCHEMA)
    rows = unique(keyed(df))
    gone = greedy(brute(rows), {r[0]: r[3] for r in rows})
    kept, metrics = duplicates.remove_duplicates(df.repartition(3))
    assert {r["place_id"] for r in kept.collect()} == {r[0] for r in rows} - gone
    assert metrics.first().asDict() == {
        "initial_rows": 100,
        "exact_removed": 100 - len(rows),
        "fuzzy_removed": len(gone),
        "total_removed": 100 - len(rows) + len(gone),
        "final_rows": len(rows) - len(gone),
    }


def test_nothing_to_remove(spark):
    df = spark.createDataFrame([(1, "Alpha", "north", 1.0), (2, "Omega", "south", 1.0)], SCHEMA)
    kept, metrics = duplicates.remove_duplicates(df)
    assert kept.count() == 2 and metrics.first()["total_removed"] == 0
    kept, metrics = duplicates.remove_duplicates(df.limit(0))
    assert kept.count() == 0 and metrics.first()["initial_rows"] == 0


GRAPHS = {
    "chain up": ([(i, i + 1) for i in range(1, 12)], lambda i: i % 5),
    "chain down": ([(i, i + 1) for i in range(1, 12)], lambda i: -i % 5),
    "star": ([(1, j) for j in range(2, 14)], lambda i: 3 if i == 9 else 1),
    "clique": (list(combinations(range(1, 12), 2)), lambda i: (i * 7) % 5),
    "three in a chain": ([(34, 65), (34, 76)], lambda i: 5 if i == 65 else 4),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_survivors_of_known_shapes(spark, name):
    pairs, rating = GRAPHS[name]
    for options in ({"task_pairs": 0}, {"task_pairs": 5, "rounds": 1}, {}):
        check_survivors(spark, pairs, rating, **options)


@pytest.mark.parametrize("seed", range(6))
def test_survivors_of_random_graphs(spark, seed):
    """Many graphs at once, side by side, by rounds only and by rounds and components."""
    rng = random.Random(seed)
    pairs = []
    for k in range(60):
        n = rng.choice([4, 6, 9, 15])
        pairs += sorted({tuple(sorted((1000 * k + a, 1000 * k + b))) for a, b in (rng.sample(range(n), 2) for _ in range(rng.choice([n, 2 * n, 4 * n])))})
    for options in ({"task_pairs": 0}, {"task_pairs": 12, "rounds": 1}):
        check_survivors(spark, pairs, lambda i: (i * 2654435761 + seed >> 7) % (2 + seed % 4), **options)


@pytest.mark.parametrize("rating", [lambda i: 1, lambda i: i, lambda i: (i * 2654435761 >> 9) % 3])
def test_a_long_chain_takes_few_rounds(spark, rating):
    history = []
    check_survivors(spark, [(i, i + 1) for i in range(1, 1002)], rating, task_pairs=0, history=history)
    assert len(history) < 30


def test_a_ladder_is_finished_by_components(spark):
    history = []
    pairs = [(i, i + step) for i in range(1, 600) for step in (1, 2)]
    check_survivors(spark, pairs, lambda i: 1, task_pairs=len(pairs) - 1, rounds=2, history=history)
    assert len(history) < 5


def test_component_labels(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 400)] + [tuple(sorted(rng.sample(range(500, 900), 2))) for _ in range(250)] + [(1000, j) for j in range(1001, 1300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = component_labels(spark.createDataFrame(pairs, "i long, j long")).collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)


def check_survivors(spark, pairs, rating, **options):
    nodes = sorted({i for p in pairs for i in p})
    ratings = {i: float(rating(i)) for i in nodes}
    got = removed_ids(
        spark.createDataFrame(pairs, "id_1 long, id_2 long").repartition(3),
        spark.createDataFrame(list(ratings.items()), "id long, rating double"),
        **options,
    )
    assert sorted(r["id"] for r in got.collect()) == sorted(greedy(pairs, ratings))


def test_missing_rating_does_not_win(spark):
    got = removed_ids(
        spark.createDataFrame([(1, 2), (3, 4)], "id_1 long, id_2 long"),
        spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, 5.0)], "id long, rating double"),
    )
    assert sorted(r["id"] for r in got.collect()) == [2, 4]


def test_plan_has_no_cartesian_product(spark):
    df = spark.createDataFrame(variants(random.Random(1), 30, BASES), SCHEMA)
    keys = duplicates.match_keys(df)
    plan = duplicates.directed_pairs(keys)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bitmaps_never_differ_in_more_places_than_the_texts(spark):
    """And nearly always in as many: a pair that characters rule out is seen."""
    rng = random.Random(17)
    texts = ["", "a", "ee" * 300, "ñandú 東京 " * 9] + ["".join(rng.choice("abcdefg hijklmnop0123ñé/") for _ in range(rng.randrange(90))) for _ in range(120)]
    rows = signature_module._bitmaps(texts)
    exact = 0
    for (i, a), (j, b) in combinations(enumerate(texts), 2):
        apart = sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
        bits = sum((int(x) ^ int(y)).bit_count() if (int(x) ^ int(y)) >= 0 else ((int(x) ^ int(y)) % (1 << 64)).bit_count() for x, y in zip(rows[i], rows[j], strict=True))
        assert bits <= apart
        exact += bits >= 0.9 * apart
    assert exact > 0.9 * 124 * 123 / 2
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(signature_module.signature("t").alias("w"))
    assert [r["w"] for r in df.collect()] == rows.tolist() + [[0] * 8]


def test_partners_rule_out_only_pairs_that_cannot_reach_the_floor(spark):
    """Rows that leave the meeting are no more than pairs within both bounds, and all that qualify."""
    rng = random.Random(23)
    rows = unique(keyed(spark.createDataFrame(variants(rng, 160, BASES), SCHEMA)))
    rows = [r for r in rows if r[1] and r[2]]
    keys = spark.createDataFrame([(r[0], r[1], r[2], 1) for r in rows], "id long, name string, location string, copies int")
    keys = keys.withColumns({f"{c}_words": signature_module.signature(c) for c in ("name", "location")})
    partner = text_join.Partner(0.6)
    texts = keys.groupBy(F.col("location").alias("text")).agg(F.min("id").alias("tid"), F.first("location_words").alias("words"), *partner.summary("name", "name_words"))
    names, places, tid = {}, {}, {}
    for r in rows:
        tid[r[2]] = min(r[0], tid.get(r[2], r[0]))
        names.setdefault(r[2], []).append(r[1])
    got = {tuple(r) for r in text_join.candidate_texts(texts, 0.85, partner=partner).collect()}

    def bound(a, b):
        return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))

    within, qualify = set(), set()
    for a, b in combinations(tid, 2):
        pair = tuple(sorted((tid[a], tid[b])))
        if bound(a, b) >= 0.85 - 1e-9 and any(bound(x, y) >= 0.6 - 1e-9 for x in names[a] for y in names[b]):
            within.add(pair)
        if max(sim(a, b), sim(b, a)) >= 0.85 and any(max(sim(x, y), sim(y, x)) >= 0.6 for x in names[a] for y in names[b]):
            qualify.add(pair)
    assert qualify <= got
    assert len(got) <= 1.1 * len(within) < 0.8 * len(list(combinations(tid, 2)))


def test_pairs_leave_a_task_in_parts(monkeypatch):
    """All texts of a list may be pairs, many more than the task's postings."""
    n = 300
    texts = [f"abcdefghij {k:03d}" for k in range(n)]
    table = pd.DataFrame({"token": 1, "first": 0, "second": 0, "role": 0, "tid": np.arange(n), "length": 14, "size": 13, "pos": 0})
    table["words"] = list(signature_module._bitmaps(texts))
    monkeypatch.setattr(text_join, "MOST_PAIRS", 3_000)
    monkeypatch.setattr(text_join, "HELD_PAIRS", 2_000)
    parts = list(text_join._meetings(text_join.GramBound(0.5), None)(iter([table.iloc[:100], table.iloc[100:]])))
    assert len(parts) > 10 and max(map(len, parts)) <= 5_000
    pairs = pd.concat(parts)
    assert len(pairs) == n * (n - 1) // 2 == len(pairs.drop_duplicates()) and (pairs["tid_1"] < pairs["tid_2"]).all()


@pytest.mark.parametrize("before", [None, 60])
@pytest.mark.parametrize("threshold", [0.85, 0.95, 0.5])
def test_blocks_and_lists_find_the_same_directed_pairs(spark, threshold, before, monkeypatch):
    rng = random.Random(11)
    rows = variants(rng, 150, ["kopi senja raya", "soto banjar asli", "bakso", "x"])
    rows += [(1_000 + i, f"kopi senja {i}", "k" * rng.randint(195, 230) + str(i), 3.0) for i in range(8)]
    keys = duplicates._comparable(duplicates.match_keys(spark.createDataFrame([r[:4] for r in rows], SCHEMA))).localCheckpoint()
    limits = Limits(before=before)
    columns = ["id_1", "id_2", "copies_1", "copies_2", "name_similarity", "location_similarity"]
    found = lambda df: Counter(tuple(r) for r in df.select(*columns).collect())
    lists = found(duplicates._listed_pairs(keys, threshold, limits))
    assert lists and found(duplicates.directed_pairs(keys, threshold, limits)) == lists
    # Many small blocks, and few pairs at a time.
    for name, size in (("BLOCK_KEYS", 32), ("SOME_PAIRS", 50)):
        monkeypatch.setattr(key_blocks, name, size)
    assert found(duplicates.directed_pairs(keys, threshold, limits)) == lists


def test_keys_that_are_alike_meet_block_by_block(spark, monkeypatch):
    """Addresses of one pattern share their q-grams, so lists would form more pairs than there are."""
    monkeypatch.setattr(duplicates, "FEW_KEYS", 0)
    monkeypatch.setattr(duplicates, "_listed_pairs", None)
    rows = [(i, f"title number {i % 7}", f"https://www.example.org/en/{1000 + i}", 3.0) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = {(r.id_1, r.id_2) for r in duplicates.find_duplicates(table).collect()}
    assert found == set(brute(unique(keyed(table))))


def test_pairs_without_copies_stand_for_themselves(spark, monkeypatch):
    """Only pairs with copies are grouped and looked up again."""
    grouped, counted = [], duplicates._one_way_pairs

    def watched(df, keys, pairs, *more):
        grouped.append(pairs.count())
        return counted(df, keys, pairs, *more)

    monkeypatch.setattr(duplicates, "_one_way_pairs", watched)
    rows = [(i, f"title number {i % 7}", f"https://www.example.org/en/{1000 + i}", 3.0) for i in range(30)]
    table = spark.createDataFrame([*rows, (100, *rows[4][1:])], SCHEMA)
    found = duplicates.duplicate_keys(table).collect()
    assert sum(r["row_pairs"] for r in found) + 1 == len(brute(keyed(table)))
    with_copies = sum(r["copies_1"] * r["copies_2"] > 1 for r in found)
    assert len(found) > 2 * with_copies > 0 and grouped == [with_copies]


def test_ids_that_repeat_are_grouped_as_before(spark):
    rows = [(i % 5, f"title number {i % 7}", f"https://www.example.org/en/{1000 + i}", 3.0) for i in range(10)]
    found = [(r["id_1"], r["id_2"]) for r in duplicates.duplicate_keys(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert found and len(found) == len(set(found))


def test_keys_that_are_alike_are_removed_in_waves(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "WAVE_KEYS", 20, raising=False)
    met, search = [], duplicates.block_pairs

    def watched(keys, count, characters, rule, before):
        met.append((count, before))
        return search(keys, count, characters, rule, before)

    monkeypatch.setattr(duplicates, "block_pairs", watched)
    rng = random.Random(4)
    table = spark.createDataFrame([(i, f"title number {i % 7}", f"https://www.example.org/en/{1000 + i}", float(rng.randint(1, 5))) for i in range(200)], SCHEMA)
    rows = unique(keyed(table))
    kept, _ = duplicates.remove_duplicates(table)
    gone = greedy(brute(rows), {r[0]: r[3] for r in rows})
    assert {r["place_id"] for r in kept.collect()} == {r[0] for r in rows} - set(gone)
    assert [before is None for _, before in met] == [False, False, True] and met[-1][0] < 100


def test_a_report_looks_texts_up_without_moving_pairs(spark):
    table = spark.createDataFrame([(i, f"title number {i % 7}", f"https://www.example.org/en/{1000 + i}", 3.0) for i in range(20)], SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = duplicates.duplicate_report(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_similar_texts_meet_block_by_block(spark, threshold, monkeypatch):
    """Without candidates of index lists; two texts of one id are no pair, and no id is none."""
    rng = random.Random(31)
    texts = sorted({f"http//www{rng.choice(['abba', 'baab', 'cab'])}example{rng.choice(['com', 'org'])}/en/{rng.randrange(200)}" for _ in range(150)} | {"x", "ab" * 30})
    rng.shuffle(texts)
    rows = [(i % 100 * 3, t) for i, t in enumerate(texts)] + [(None, texts[0] + "/1")]
    df = spark.createDataFrame(rows, "tid long, text string").repartition(4)
    want = {}
    for a, b in combinations(sorted(r for r in rows if r[0] is not None), 2):
        both = tuple(s if s >= threshold else None for s in (sim(a[1], b[1]), sim(b[1], a[1])))
        if a[0] < b[0] and any(both):
            want.setdefault((a[0], b[0]), []).append(both)
    lists = text_join.candidate_texts
    monkeypatch.setattr(text_join, "candidate_texts", None)
    for size in (4_096, 20):
        monkeypatch.setattr(key_blocks, "BLOCK_KEYS", size)
        got = {}
        for r in text_join.similar_texts(df, threshold).collect():
            got.setdefault((r["tid_1"], r["tid_2"]), []).append((r["forward"], r["backward"]))
        order = lambda found: sorted(found, key=str)
        assert {p: order(f) for p, f in got.items()} == {p: order(f) for p, f in want.items()}
    monkeypatch.setattr(text_join, "candidate_texts", lists)
    monkeypatch.setattr(text_join, "FEW_LONG", -1)
    by_lists = text_join.similar_texts(df, threshold).collect()
    assert Counter((r[0], r[1]) for r in by_lists) == Counter({p: len(f) for p, f in want.items()})


def test_many_texts_that_are_alike_meet_block_by_block_too(spark, monkeypatch):
    alike = spark.createDataFrame([(i, f"http//www.example.org/en/{i}") for i in range(300)], "tid long, text string")
    rng = random.Random(5)
    unlike = spark.createDataFrame([(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))) for i in range(300)], "tid long, text string")
    monkeypatch.setattr(text_join, "FEW_TEXTS", 10)
    assert text_join._blocks_suit(alike, 300, 0, 0.85) and not text_join._blocks_suit(unlike, 300, 0, 0.85)
