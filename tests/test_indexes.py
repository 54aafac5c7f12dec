"""Layouts answer like scans, and read little."""

import glob

import pyarrow.parquet as pq
import pytest
from conftest import PLACE
from pyspark.sql import functions as F

from venuegrid.operators import duplicates, paging, recommend
from venuegrid.operators.filters import listing_filter
from venuegrid.plans import pair_table
from venuegrid.plans.pair_table import PairTable
from venuegrid.plans.requests import Places
from venuegrid.sources import indexes


@pytest.fixture(scope="module")
def table(spark):
    words = ["Soto", "Kopi", "Nasi", "Éclair", "100%_x", "東京 ラーメン", "bolt"]
    rows = []
    for k in range(3000):
        name = None if k % 41 == 0 else f"{words[k % 7]} {words[k * k % 5]} {k % 97}" if k % 13 else "ab"
        rows.append((k * 7 % 3001, name, f"t{k % 4}", float(k % 50), None if k % 9 == 0 else float(k % 5), None, None if k % 11 == 0 else float(k % 17), k % 3))
    return spark.createDataFrame(rows, PLACE)


@pytest.fixture(scope="module")
def store(table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    indexes.write_indexes(table, path, range_rows=250)
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("query", ["soto", " KOPI s", "100%_x", "東京", "ラーメン", "ab", "b", "éclair nasi 4", "nothing like it", "o k"])
def test_search_equals_the_scan(spark, table, store, query):
    assert rows(indexes.search(spark, store, query, 20)) == rows(recommend.search(table, query, limit=20))


def test_search_needs_text(spark, store):
    with pytest.raises(ValueError):
        indexes.search(spark, store, "  ")


def test_search_and_lookup_push_their_filters_down(spark, store):
    plan = indexes.matches(spark, store, "ram")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,ram)]" in plan
    found = indexes.lookup(spark, store, 77, 2500)
    assert sorted(r["place_id"] for r in found.collect()) == [77, 2500]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert pushed and "In(place_id" in pushed[0].replace("Or(EqualTo(place_id", "In(place_id"), plan


def test_ids_and_grams_lie_in_ranges(store):
    """A lookup reads one file's row groups, a search those of its gram."""
    for folder, column in ((indexes.BY_ID, "place_id"), (indexes.GRAMS, "gram")):
        bounds = []
        for path in glob.glob(f"{store}/{folder}/*.parquet"):
            values = pq.read_table(path, columns=[column])[column].to_pylist()
            assert values == sorted(values)
            bounds.append((min(values), max(values)))
        bounds.sort()
        assert len(bounds) > 5 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False))


@pytest.mark.parametrize("number", [1, 2, 13, 75, 150, 151, 400])
def test_pages_equal_those_of_the_sorted_list(spark, table, store, number):
    for criteria in ({}, {"max_price": 30, "type": "t1"}):
        got = indexes.page(spark, store, number, **criteria)
        want = paging.page(listing_filter(table, **criteria), number)
        assert rows(got.select(*want.columns)) == rows(want)


def test_a_deep_page_reads_the_ranges_it_touches(spark, store):
    found = indexes.page(spark, store, 100)
    inputs = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(inputs) <= 2
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "range" in plan.split("PartitionFilters")[1][:80]


def test_short_ranges_do_not_multiply_files(spark, table, tmp_path):
    """Each partition of an exchange sends a sample to the driver, so short ranges must not make many."""
    path = str(tmp_path)
    indexes.write_indexes(table, path, range_rows=10)
    for folder in (indexes.BY_ID, indexes.GRAMS):
        assert len(glob.glob(f"{path}/{folder}/*.parquet")) <= indexes.FEW_FILES
    ranges = spark.read.parquet(f"{path}/{indexes.BY_RATING}").groupBy("range").count().collect()
    assert max(r["count"] for r in ranges) == 10 and sum(r["count"] for r in ranges) == 3000
    assert len(glob.glob(f"{path}/{indexes.BY_RATING}/*/*.parquet")) == len(ranges) <= 300 + indexes.FEW_FILES
    for number in (1, 75, 150, 151):
        want = paging.page(table, number)
        assert rows(indexes.page(spark, path, number).select(*want.columns)) == rows(want)
    assert rows(indexes.search(spark, path, "kopi", 20)) == rows(recommend.search(table, "kopi", limit=20))


@pytest.fixture
def searches(monkeypatch):
    calls = []
    real = duplicates.directed_pairs
    monkeypatch.setattr(duplicates, "directed_pairs", lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


NEAR = [(k, f"kopi senja {k % 3} cabang", None, None, 3.0 + k % 2, f"jalan mawar {k % 5}", None, None) for k in range(24)]


def test_reports_share_one_search(spark, searches):
    df = spark.createDataFrame(NEAR, PLACE)
    places = Places(df)
    score = places.quality_report().select("statistics.potential_duplicates").first()[0]
    report = places.duplicate_report()
    kept, metrics = places.duplicates().removal()
    assert report.agg(F.sum("row_pairs")).first()[0] == score > 50 and metrics.first()["final_rows"] == kept.count()
    assert len(searches) == 1
    assert sorted(r[0] for r in kept.select("place_id").collect()) == sorted(r[0] for r in duplicates.remove_duplicates(df)[0].select("place_id").collect())


def test_stored_pairs_are_found_again_for_the_same_table_only(spark, searches, tmp_path):
    df = spark.createDataFrame(NEAR, PLACE)
    first = PairTable(df, store=str(tmp_path)).count()
    assert PairTable(df.repartition(3), store=str(tmp_path)).count() == first and len(searches) == 1
    changed = df.withColumn("name", F.when(F.col("place_id") == 3, "other").otherwise(F.col("name")))
    assert PairTable(changed, store=str(tmp_path)).count() < first and len(searches) == 2
    assert PairTable(df, 0.95, str(tmp_path)).stamp() != PairTable(df, store=str(tmp_path)).stamp()
    assert pair_table.STAGE in {p.name for p in tmp_path.iterdir()}


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_one_way_pairs_of_copies_are_counted_by_ranges_of_ids(spark, block_rows):
    one, two = ("kopi senja abc d", "x"), ("kopi senja", "y")
    rng = __import__("random").Random(block_rows)
    ids = rng.sample(range(10**6), 60)
    df = spark.createDataFrame([(i, *(one if k % 3 else two)) for k, i in enumerate(ids)], "place_id long, name string, location string")
    keys = duplicates.match_keys(df)
    low, high = sorted(r["id"] for r in keys.collect())
    left = [i for k, i in enumerate(ids) if bool(k % 3) == (min(x for q, x in enumerate(ids) if q % 3) == low)]
    right = [i for i in ids if i not in set(left)]
    pairs = spark.createDataFrame([(low, high, True, False, 800)], "low long, high long, straight boolean, swapped boolean, product long")
    got = duplicates._one_way_pairs(df, keys, pairs, "name", "location", "place_id", block_rows).first()["some"]
    assert got == sum(a < b for a in left for b in right)
