import pandas as pd
import pytest
from conftest import PLACE, ids
from pyspark.sql import functions as F

from venuegrid.operators import filters, paging, ranking, recommend, similar
from venuegrid.operators.ranking import with_hybrid_score
from venuegrid.plans.requests import Places


def test_filters(places):
    assert ids(filters.filter_places(places, min_price=12000, max_price=30000, min_rating=4)) == [2, 3, 5]
    assert ids(filters.filter_places(places, type=["Cafe"], max_distance=1)) == [4]
    assert ids(filters.filter_places(places, type="war")) == [1, 3]
    assert len(ids(filters.filter_places(places, min_price=None, type=None))) == 7
    assert ids(filters.search_name(places, " (")) == [6]
    assert ids(filters.search_name(places, "50%")) == [5]
    with pytest.raises(ValueError):
        filters.search_name(places, "  ")
    assert filters.preset("mid-range") == {"min_price": 15000, "max_price": 30000}
    assert filters.preset("2") == {"cluster_id": 2}


def test_zero_limits_differ_between_filters(places):
    assert ids(filters.recommendation_filter(places, max_price=0)) == []
    assert len(ids(filters.diverse_filter(places, max_price=0, max_distance=0, min_rating=0))) == 7
    assert ids(filters.recommendation_filter(places, max_distance=0)) == []


def test_listing_filter_ignores_absent_columns(places):
    assert len(ids(filters.listing_filter(places.drop("cluster", "distance"), cluster_id=1, max_distance=1))) == 7
    assert ids(filters.listing_filter(places, cluster_id=1)) == [2, 4]


def test_preferences(places):
    wish = {"price_range": [0, 50000], "max_distance": 2, "types": ["Cafe", "Warung"]}
    got = recommend.recommend_personalized(places, wish).collect()
    assert sorted(r["place_id"] for r in got) == [1, 2, 3, 4]
    assert all(0 <= r["personalized_score"] <= 1.0000001 for r in got)
    assert recommend.recommend_personalized(places.limit(0), {}).count() == 0
    same = places.withColumn("rating", F.lit(4.0))
    assert all(r["personalized_score"] is not None for r in recommend.recommend_personalized(same).collect())


def test_orders_and_ties(places):
    assert ids(recommend.recommend(places)) == [2, 5, 6, 1, 3, 7, 4]
    assert ids(recommend.recommend(places, sort_by="distance")) == [4, 1, 3, 2, 5, 7, 6]
    assert ids(recommend.recommend(places, sort_by="price", limit=2)) == [1, 3]
    assert ids(recommend.recommend(places, sort_by="unknown", limit=3)) == [1, 2, 3]
    row = recommend.recommend(places, limit=1).first()
    assert row["price"] == 30000 and row["hybrid_score"] is None


def test_hybrid_score_against_pandas(places):
    pdf = places.toPandas()
    unit = lambda c: (pdf[c] - pdf[c].min()) / (pdf[c].max() - pdf[c].min())
    pdf["s"] = 0.4 * unit("rating") + 0.35 * (1 - unit("distance")) + 0.25 * (1 - unit("price"))
    want = pdf.sort_values(["s", "place_id"], ascending=[False, True])
    got = recommend.recommend(places, sort_by="hybrid", limit=7).collect()
    assert [r["place_id"] for r in got] == want["place_id"].tolist()
    assert [r["hybrid_score"] for r in got] == pytest.approx(want["s"].tolist())


def test_hybrid_score_of_a_constant_measure(places):
    same = places.withColumn("rating", F.lit(4.0))
    assert ids(recommend.recommend(same, sort_by="hybrid", limit=2)) == [1, 2]
    assert with_hybrid_score(same).where("hybrid_score is not null").count() == 0
    assert with_hybrid_score(same, constant=0.5).where("hybrid_score is null").count() == 0


def diverse(rows, limit):
    """Straight reading of the rule: quotas, then a fill by unseen names."""
    pdf = pd.DataFrame(rows, columns=["id", "name", "rating", "distance", "cluster"])
    best = pdf.sort_values(["rating", "distance", "id"], ascending=[False, True, True])
    order = pdf.sort_values("id")["cluster"].drop_duplicates().tolist()
    quota = max(1, limit // len(order))
    picked = [i for c in order for i in best[best["cluster"] == c].head(quota)["id"]]
    spare = limit - quota * len(order)
    if spare > 0:
        names = set(pdf[pdf["id"].isin(picked)]["name"])
        picked += best[~best["name"].isin(names)].head(spare)["id"].tolist()
    return picked[:limit]


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 7, 10, 40])
def test_diverse(spark, limit):
    rows = [(i, f"n{i % 9}", float(1 + (i * 7) % 5), float((i * 5) % 4), (i * i + 1) % 4) for i in range(1, 31)]
    df = spark.createDataFrame(
        [(i, n, "t", 1.0, r, "l", d, c) for i, n, r, d, c in rows], PLACE
    )
    assert ids(recommend.recommend_diverse(df, limit=limit)) == diverse(rows, limit)


def test_diverse_of_nothing(places):
    assert recommend.recommend_diverse(places, max_price=1).count() == 0


def test_top_n_is_cut_before_the_shuffle(places):
    plan = recommend.recommend_diverse(places)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = recommend.recommend(places)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_cluster_top(places):
    assert ids(recommend.recommend_in_cluster(places, 1)) == [2, 4]
    assert ids(recommend.recommend_in_cluster(places, 1, sort_by="price")) == [4, 2]
    assert ids(recommend.recommend_in_cluster(places, 5)) == []


def test_pages(places):
    pages = [paging.page(places, n, 3).collect() for n in (1, 2, 3, 4)]
    assert [r["place_id"] for p in pages for r in p] == ids(recommend.recommend(places))
    assert [r["index"] for p in pages for r in p] == list(range(7))
    info = paging.page_info(places, 3, 3).first()
    assert tuple(info) == (3, 3, 7, 3, True, False, 2, None)
    assert paging.page_info(places, 0, 3).first()["has_next"] is True
    assert paging.page(places, 1, 100).count() == 7
    last = pages[0][-1].asDict()
    assert [r["place_id"] for r in paging.page_after(places, last, 3).collect()] == [r["place_id"] for r in pages[1]]
    options = [tuple(r) for r in paging.filter_options(places).collect()]
    assert options == [("type", "Cafe"), ("type", "Indoor"), ("type", "Warung"), ("cluster", "0"), ("cluster", "1"), ("cluster", "2")]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_pages_after_reach_every_row(spark, size):
    """Null ratings and distances come last and are paged through like others."""
    rows = [(i, r, d) for i, (r, d) in enumerate([(4.0, 1.0), (4.0, None), (4.0, None), (None, 2.0), (None, 2.0), (None, None), (3.0, 1.0), (4.0, 1.0), (None, None)])]
    df = spark.createDataFrame(rows, "place_id long, rating double, distance double")
    want = [r["place_id"] for r in df.orderBy(*ranking.order_for("rating")).collect()]
    got, last = [], None
    while page := paging.page_after(df, last, size).collect():
        got += [r["place_id"] for r in page]
        last = page[-1].asDict()
    assert got == want and len(got) == len(rows)


def test_infinite_prices_are_shown_as_null(places):
    one = places.where("place_id < 3").withColumn("price", F.when(F.col("place_id") == 1, float("inf")).otherwise(F.col("price")))
    assert {r["place_id"]: r["price"] for r in recommend.recommend(one).collect()} == {1: None, 2: 30000}


def test_filters_on_absent_columns_are_errors(places):
    with pytest.raises(ValueError):
        filters.recommendation_filter(places.drop("price"), max_price=1).count()
    with pytest.raises(ValueError):
        filters.recommendation_filter(places, cluster_name="Premium").count()
    assert filters.listing_filter(places.drop("price"), max_price=1).count() == 7


def test_detail_has_as_many_as_asked_for(places):
    assert similar.place_detail(places, 1, 50).count() == 1 + similar.similar_places(places, 1, 50).count()


def test_requests(places):
    named = places.withColumn("cluster_name", F.when(F.col("cluster") == 0, "Ekonomis").otherwise("Premium"))
    api = Places(named)
    assert ids(api.recommendations(preset="ekonomis")) == [5, 1, 3]
    assert ids(api.recommendations(cluster_names="PREMIUM, x", place_type="cafe")) == [2, 4]
    assert ids(api.recommendations("cluster", cluster_id=1, limit=500)) == [2, 4]
    assert len(ids(api.recommendations("diverse", limit=3))) == 3
    assert api.total_found(preset="budget-friendly").first()[0] == 3
    assert ids(api.search("KOPI")) == [2, 4]
    assert ids(api.place(3)) == [3] and ids(api.place(99)) == []
    assert ids(api.cluster_page(2)) == [6, 7]
    assert len(ids(api.listing(1, 5))) == 5 and api.listing_info(1, 5).first()["pages"] == 2
    detail = api.detail(1, 99).collect()
    assert [r["rank"] for r in sorted(detail, key=lambda r: r["rank"])][0] == 0
    assert next(r for r in detail if r["rank"] == 0)["place_id"] == 1
    assert api.detail(12345).count() == 0
    assert ids(api.featured())[0] in (2, 5)
    assert api.stats().first()["total"] == 7 and api.clusters().count() == 3
