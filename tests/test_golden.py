"""Results known for one real source file, given by PLACES_CSV."""

import os

import pytest

from venuegrid.operators import duplicates
from venuegrid.operators.cleaning import clean_places, iqr_bounds
from venuegrid.operators.clustering import fit_clusters
from venuegrid.plans.requests import Places
from venuegrid.sources.csv_source import read_places

PATH = os.environ.get("PLACES_CSV")
pytestmark = pytest.mark.skipif(not PATH, reason="set PLACES_CSV to the source file")

# First line of each near-duplicate pair, second line, both similarities.
PAIRS = [
    (4, 37, 1.0, 0.466), (6, 39, 1.0, 0.408), (11, 45, 1.0, 0.543), (28, 40, 1.0, 0.593), (30, 41, 1.0, 0.519),
    (32, 48, 0.727, 1.0), (34, 65, 0.943, 0.593), (34, 76, 0.851, 0.682), (50, 57, 0.87, 1.0), (51, 79, 1.0, 0.568),
    (53, 55, 1.0, 0.593), (68, 100, 1.0, 0.614), (89, 101, 0.955, 0.705),
]
REMOVED = {49, 52, 78} | {4, 34, 39, 40, 41, 45, 48, 51, 55, 57, 89, 100}


@pytest.fixture(scope="module")
def clean(spark):
    return clean_places(read_places(spark, PATH)).persist()


@pytest.fixture(scope="module")
def kept(clean):
    return duplicates.remove_duplicates(clean)[0].persist()


def test_duplicates(clean, kept):
    assert clean.count() == 100
    pairs = duplicates.find_duplicates(clean).collect()
    assert sorted((r[0] + 2, r[1] + 2, round(r[2], 3), round(r[3], 3)) for r in pairs) == PAIRS
    assert {r["place_id"] + 2 for r in clean.collect()} - {r["place_id"] + 2 for r in kept.collect()} == REMOVED


def test_cleaned_rows(kept):
    stats = Places(kept).stats().first()
    assert tuple(stats) == (85, pytest.approx(20876.470588, abs=1e-6), pytest.approx(4.247059, abs=1e-6), pytest.approx(1.331176, abs=1e-6))
    assert iqr_bounds(kept, "price") == (0.0, 40000.0)
    assert iqr_bounds(kept, "distance") == pytest.approx((-0.55, 3.05))
    report = Places(kept).quality_report().first()
    assert (report["score"], report["statistics"]["potential_duplicates"]) == (100.0, 0)


def test_clusters(kept):
    model, assigned = fit_clusters(kept, 3)
    m = model.info.metrics
    assert model.info.rows == 82
    assert model.info.inertia == pytest.approx(194.636196, abs=1e-5)
    assert m["silhouette"] == pytest.approx(0.270547, abs=1e-6)
    assert m["calinski_harabasz"] == pytest.approx(27.065213, abs=1e-5)
    assert m["davies_bouldin"] == pytest.approx(1.365095, abs=1e-6)
    assert m["balance_score"] == pytest.approx(0.552587, abs=1e-6)
    assert m["price_separation"] == pytest.approx(0.227006, abs=1e-6)
    profile = Places(assigned, kept, model).clusters().collect()
    assert [(r["count"], r["avg_price"]) for r in profile] == [(44, 18875.0), (23, 19000.0), (15, 29800.0)]
    share = {r["feature"]: round(r["importance"], 4) for r in model.feature_importance().collect()}
    assert share == {"price": 0.2023, "rating": 0.0223, "distance": 0.3206, "type_encoded": 0.4548}
