"""The batch run on a made-up source with known traits: near copies, exact copies, gaps, values
out of range and a price far off."""

import csv
import random

import pytest
from test_duplicates import brute, greedy, keyed, unique

from venuegrid.operators.cleaning import SOURCE_HEADERS
from venuegrid.operators.quality import table_profile
from venuegrid.plans.requests import Places
from venuegrid.plans.workflow import run

HEADERS = {role: header for header, role in SOURCE_HEADERS.items()}


def source_rows():
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("bdghjklmnprst") + rng.choice("aeiou") for _ in range(n)).title()
    rows = []
    for k in range(80):
        kind, price = (("Warung", 12000), ("Cafe", 32000), ("Restoran", 61000))[k % 3]
        rows.append([f"{word(4)} {word(5)}", kind, price + 250 * (k % 9), 3 + k % 3, f"{word(6)} {word(5)} {k}", round(0.5 + k % 7 * 0.4, 1)])
    near = [[rows[k][0] + "s", *rows[k][1:3], 5 if k % 2 else 3, rows[k][4], rows[k][5]] for k in range(0, 26, 2)]
    same = [list(rows[k]) for k in (3, 9)]
    faulty = [["No Price", "Cafe", "n/a", 4, "Jl. Aneh 1", 1.0], ["Too Good", "Cafe", 30000, 9, "Jl. Aneh 2", 1.0], ["", "Cafe", 30000, 4, "", 1.0]]
    far = [["Istana Emas", "Restoran", 900000, 5, "Jl. Jauh Sekali 99", 1.0]]
    return rows + near + same + faulty + far


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    path = folder / "places.csv"
    with path.open("w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow([HEADERS[c] for c in ("name", "type", "price", "rating", "location", "distance")])
        writer.writerows(source_rows())
    return run(spark, str(path), store=str(folder / "store"), silhouette=None, restarts=3)


def test_removal_follows_the_rule(result):
    removal = result.removal.first()
    assert removal["initial_rows"] - removal["exact_removed"] - removal["fuzzy_removed"] == removal["final_rows"] == result.cleaned.count()
    assert removal["exact_removed"] == 2 and removal["fuzzy_removed"] == 13


def test_what_stays_has_no_near_copies(spark, result):
    rows = keyed(result.cleaned)
    assert len(unique(rows)) == len(rows)
    pairs = brute(rows)
    assert not greedy(pairs, {r[0]: r[3] for r in rows})
    names = {r["name"] for r in result.cleaned.select("name").collect()}
    assert "No Price" not in names and "Too Good" not in names and "Istana Emas" in names


def test_clusters_leave_out_the_far_price(result):
    clustered = result.clustered
    assert "Istana Emas" not in {r["name"] for r in clustered.select("name").collect()}
    assert {r[0] for r in clustered.select("cluster_name").distinct().collect()} == {"Ekonomis", "Menengah", "Premium"}
    assert result.model.info.rows == clustered.count()


def test_reports_agree(result):
    places = Places(result.clustered, result.cleaned, result.model)
    report = places.duplicate_report()
    assert report.count() == 0 == places.quality_report().select("statistics.potential_duplicates").first()[0]


def test_zero_has_one_text(spark):
    df = spark.createDataFrame([(1, 0.0), (1, -0.0), (2, 1.0)], "a long, b double")
    assert table_profile(df).first()["duplicate_rows"] == 1
