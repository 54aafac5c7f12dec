"""Catalog: filters, orders, recommendations, paging and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, paging, profiles, recommend, statistics
from ..runtime import scratch_folder
from ..schema import result_rows
from ..sources import indexes
from .registry import query, rounded
from .views import view

ROW = "place_id, name, type, CAST(trunc(price) AS BIGINT) AS price, rating, distance, location, cluster"
NO_SCORE = "CAST(NULL AS DOUBLE) AS hybrid_score"
BY_RATING = "rating DESC NULLS LAST, distance ASC NULLS LAST, place_id"


@query(
    "recommend_by_rating",
    "offers",
    check=f"""
    SELECT {ROW}, {NO_SCORE} FROM offers
    WHERE price <= 300000 AND distance <= 4.0 AND rating >= 3 AND lower(type) LIKE '%high%'
    ORDER BY {BY_RATING} LIMIT 10""",
)
def recommend_by_rating(spark, folder) -> DataFrame:
    return recommend.recommend(
        view(spark, folder, "offers"), max_price=300000, max_distance=4.0, min_rating=3, type="HIGH"
    )


@query(
    "recommend_by_distance",
    "offers",
    check=f"""
    SELECT {ROW}, {NO_SCORE} FROM offers WHERE cluster = 1 AND price >= 200000
    ORDER BY distance, rating DESC, place_id LIMIT 50""",
)
def recommend_by_distance(spark, folder) -> DataFrame:
    return recommend.recommend(
        view(spark, folder, "offers"), cluster_id=1, min_price=200000, sort_by="distance", limit=50
    )


LABELS = """WITH labels_by_price AS (
      SELECT cluster, CASE row_number() OVER (ORDER BY avg(price), cluster)
             WHEN 1 THEN 'Ekonomis' WHEN 2 THEN 'Menengah' ELSE 'Premium' END AS cluster_name
      FROM offers GROUP BY cluster)"""


@query(
    "recommend_by_price",
    "offers",
    check=f"""{LABELS}
    SELECT place_id, name, type, CAST(trunc(price) AS BIGINT) AS price, rating, distance, location, o.cluster, {NO_SCORE}
    FROM offers o JOIN labels_by_price l ON o.cluster = l.cluster
    WHERE l.cluster_name IN ('Ekonomis', 'Premium')
    ORDER BY price, rating DESC, place_id LIMIT 20""",
)
def recommend_by_price(spark, folder) -> DataFrame:
    offers = view(spark, folder, "offers")
    named = profiles.with_cluster_names(offers, profiles.cluster_names(offers))
    return recommend.recommend(named, cluster_names="ekonomis, PREMIUM", sort_by="price", limit=20)


@query(
    "recommend_by_cluster_name",
    "offers",
    check=f"""{LABELS}
    SELECT place_id, name, type, CAST(trunc(price) AS BIGINT) AS price, rating, distance, location, o.cluster, {NO_SCORE}
    FROM offers o JOIN labels_by_price l ON o.cluster = l.cluster
    WHERE l.cluster_name = 'Menengah' ORDER BY rating DESC, distance, place_id LIMIT 10""",
)
def recommend_by_cluster_name(spark, folder) -> DataFrame:
    offers = view(spark, folder, "offers")
    named = profiles.with_cluster_names(offers, profiles.cluster_names(offers))
    return recommend.recommend(named, **filters.preset("menengah"))


@query(
    "recommend_hybrid",
    "offers",
    check="""
    WITH found AS (SELECT * FROM offers WHERE rating >= 4.0),
    ends AS (SELECT min(rating) r0, max(rating) r1, min(distance) d0, max(distance) d1, min(price) p0, max(price) p1 FROM found),
    scored AS (SELECT found.*, 0.4 * ((rating - r0) / (r1 - r0)) + 0.35 * (1.0 - ((distance - d0) / (d1 - d0)))
               + 0.25 * (1.0 - ((price - p0) / (p1 - p0))) AS s FROM found, ends)
    SELECT place_id, name, type, CAST(trunc(price) AS BIGINT) AS price, rating, distance, location, cluster,
           round(s, 6) AS hybrid_score
    FROM scored ORDER BY s DESC NULLS LAST, place_id LIMIT 15""",
)
def recommend_hybrid(spark, folder) -> DataFrame:
    found = recommend.recommend(view(spark, folder, "offers"), min_rating=4.0, limit=15, sort_by="hybrid")
    return rounded(found, "hybrid_score")


@query(
    "recommend_personalized",
    "offers",
    check="""
    WITH found AS (SELECT * FROM offers WHERE price >= 20000 AND price <= 400000 AND distance <= 4.5 AND rating >= 2
                   AND type IN ('2-HIGH', '5-LOW')),
    ends AS (SELECT min(rating) r0, max(rating) r1, min(distance) d0, max(distance) d1, min(price) p0, max(price) p1 FROM found),
    scored AS (SELECT found.*, 0.5 * (1.0 - (price - p0) / (p1 - p0 + 1e-8)) + 0.3 * (1.0 - (distance - d0) / (d1 - d0 + 1e-8))
               + 0.4 * ((rating - r0) / (r1 - r0 + 1e-8)) AS s FROM found, ends)
    SELECT place_id, name, type, CAST(trunc(price) AS BIGINT) AS price, rating, distance, location, cluster,
           round(s, 6) AS personalized_score
    FROM scored ORDER BY s DESC, place_id LIMIT 10""",
)
def recommend_personalized(spark, folder) -> DataFrame:
    wishes = {
        "price_range": (20000, 400000),
        "max_distance": 4.5,
        "min_rating": 2,
        "types": ["2-HIGH", "5-LOW"],
        "price_weight": 0.5,
    }
    return rounded(recommend.recommend_personalized(view(spark, folder, "offers"), wishes), "personalized_score")


@query(
    "recommend_cluster_topn",
    "offers",
    check=f"SELECT {ROW} FROM offers WHERE cluster = 2 ORDER BY {BY_RATING} LIMIT 20",
)
def recommend_cluster_topn(spark, folder) -> DataFrame:
    return recommend.recommend_in_cluster(view(spark, folder, "offers"), 2, limit=20)


@query(
    "recommend_diverse",
    "offers",
    check=f"""
    WITH found AS (SELECT * FROM offers WHERE price <= 450000 AND distance <= 4.0),
    arrivals AS (SELECT cluster AS c, min(place_id) AS arrival FROM found GROUP BY cluster),
    ranked AS (SELECT found.*, arrival, row_number() OVER (PARTITION BY cluster ORDER BY {BY_RATING}) AS rk
               FROM found JOIN arrivals ON cluster = c),
    quota AS (SELECT greatest(1, 11 // count(*)) AS q, count(*) AS k FROM arrivals),
    chosen AS (SELECT 0 AS phase, ranked.* FROM ranked, quota WHERE rk <= q),
    fill AS (SELECT found.*, row_number() OVER (ORDER BY {BY_RATING}) AS rk FROM found
             WHERE name NOT IN (SELECT name FROM chosen)),
    both_parts AS (SELECT phase, arrival, rk, place_id, name, type, price, rating, distance, location, cluster FROM chosen
             UNION ALL SELECT 1, 0, rk, place_id, name, type, price, rating, distance, location, cluster
             FROM fill, quota WHERE rk <= 11 - q * k)
    SELECT {ROW} FROM both_parts ORDER BY phase, arrival, rk LIMIT 11""",
)
def recommend_diverse(spark, folder) -> DataFrame:
    return recommend.recommend_diverse(view(spark, folder, "offers"), limit=11, max_price=450000, max_distance=4.0, min_rating=0)


@query(
    "count_matches",
    "offers",
    check="SELECT count(*) AS total_found FROM offers WHERE price <= 300000 AND rating >= 3",
)
def count_matches(spark, folder) -> DataFrame:
    return recommend.count_matches(view(spark, folder, "offers"), max_price=300000, min_rating=3)


@query(
    "filter_dynamic",
    "places",
    check="""SELECT * FROM places WHERE price >= 905 AND price <= 1040 AND rating >= 2 AND rating <= 4
             AND distance >= 0.5 AND distance <= 4.5 AND lower(type) LIKE '%all%'""",
)
def filter_dynamic(spark, folder) -> DataFrame:
    return filters.filter_places(
        view(spark, folder, "places"),
        min_price=905, max_price=1040, min_rating=2, max_rating=4, min_distance=0.5, max_distance=4.5, type="ALL",
    )


@query(
    "filter_type_list",
    "places",
    check="SELECT * FROM places WHERE type IN ('SMALL', 'PROMO') AND rating >= 4",
)
def filter_type_list(spark, folder) -> DataFrame:
    return filters.filter_places(view(spark, folder, "places"), type=["SMALL", "PROMO"], min_rating=4)


@query(
    "filter_presets",
    "offers",
    check="""
    SELECT 'budget-friendly' AS preset, count(*) AS places, round(avg(price), 6) AS avg_price FROM offers WHERE price <= 15000
    UNION ALL SELECT 'mid-range', count(*), round(avg(price), 6) FROM offers WHERE price >= 15000 AND price <= 30000
    UNION ALL SELECT 'expensive', count(*), round(avg(price), 6) FROM offers WHERE price >= 30000
    UNION ALL SELECT '1', count(*), round(avg(price), 6) FROM offers WHERE cluster = 1""",
)
def filter_presets(spark, folder) -> DataFrame:
    offers = view(spark, folder, "offers")
    parts = [
        filters.recommendation_filter(offers, **filters.preset(choice)).agg(
            F.lit(str(choice)).alias("preset"), F.count("*").alias("places"), F.round(F.avg("price"), 6).alias("avg_price")
        )
        for choice in ("budget-friendly", "mid-range", "expensive", 1)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "filter_presets_by_name",
    "named",
    check="""
    SELECT 'ekonomis' AS preset, count(*) AS places FROM named WHERE cluster_name = 'Ekonomis'
    UNION ALL SELECT 'menengah', count(*) FROM named WHERE cluster_name = 'Menengah'
    UNION ALL SELECT 'premium', count(*) FROM named WHERE cluster_name = 'Premium'
    UNION ALL SELECT 'ekonomis-menengah', count(*) FROM named WHERE cluster_name IN ('Ekonomis', 'Menengah')
    UNION ALL SELECT 'menengah-premium', count(*) FROM named WHERE cluster_name IN ('Menengah', 'Premium')""",
)
def filter_presets_by_name(spark, folder) -> DataFrame:
    named = view(spark, folder, "named")
    parts = [
        filters.recommendation_filter(named, **filters.preset(choice)).agg(F.lit(choice).alias("preset"), F.count("*").alias("places"))
        for choice in ("ekonomis", "menengah", "premium", "ekonomis-menengah", "menengah-premium")
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "member_types",
    "places",
    check="""SELECT place_id, type FROM places WHERE type IN (SELECT p_type FROM part WHERE p_size = 50)""",
)
def member_types(spark, folder) -> DataFrame:
    """Places whose type is in a list that is itself a table."""
    listed = spark.read.parquet(f"{folder}/part.parquet").where("p_size = 50").select(F.col("p_type").alias("type"))
    return filters.member_of(view(spark, folder, "places"), listed, "type").select("place_id", "type")


@query(
    "search_name",
    "places",
    check=f"SELECT {ROW} FROM places WHERE contains(lower(name), 'bolt') ORDER BY {BY_RATING} LIMIT 50",
)
def search_name(spark, folder) -> DataFrame:
    return recommend.search(view(spark, folder, "places"), " Bolt ", limit=50)


@query(
    "search_text",
    "texts",
    check="""SELECT place_id, name, type, CAST(trunc(price) AS BIGINT) AS price, rating, distance, location,
             CAST(NULL AS INT) AS cluster FROM texts WHERE contains(lower(name), 'the') ORDER BY """
    + BY_RATING
    + " LIMIT 10",
)
def search_text(spark, folder) -> DataFrame:
    return recommend.search(view(spark, folder, "texts"), "THE")


@query("lookup_by_id", "offers", check=f"SELECT {ROW} FROM offers WHERE place_id = 77")
def lookup_by_id(spark, folder) -> DataFrame:
    return result_rows(filters.by_id(view(spark, folder, "offers"), 77))


@query(
    "list_page",
    "offers",
    check=f"""SELECT *, row_number() OVER (ORDER BY {BY_RATING}) + 39 AS index FROM
    (SELECT * FROM offers WHERE price <= 400000 AND rating >= 2 AND lower(type) LIKE '%low%'
     ORDER BY {BY_RATING} LIMIT 20 OFFSET 40)""",
)
def list_page(spark, folder) -> DataFrame:
    found = filters.listing_filter(view(spark, folder, "offers"), max_price=400000, min_rating=2, type="low")
    return paging.page(found, 3)


@query(
    "list_page_after",
    "offers",
    check=f"SELECT * FROM offers WHERE (rating < 4 OR (rating = 4 AND (distance > 2.5 OR (distance = 2.5 AND place_id > 500)))) ORDER BY {BY_RATING} LIMIT 20",
)
def list_page_after(spark, folder) -> DataFrame:
    return paging.page_after(view(spark, folder, "offers"), {"rating": 4.0, "distance": 2.5, "place_id": 500})


@query(
    "list_page_after_unrated",
    "unrated",
    check=f"""SELECT 'unrated' AS after, * FROM (SELECT * FROM unrated WHERE rating IS NULL AND
      (distance > 1.5 OR distance IS NULL OR (distance = 1.5 AND place_id > 500)) ORDER BY {BY_RATING} LIMIT 200)
    UNION ALL SELECT 'no distance' AS after, * FROM (SELECT * FROM unrated WHERE rating < 1 OR rating IS NULL
      OR (rating = 1 AND distance IS NULL AND place_id > 500) ORDER BY {BY_RATING} LIMIT 200)""",
)
def list_page_after_unrated(spark, folder) -> DataFrame:
    """The pages after a row without a rating, and after one without a distance."""
    rows = view(spark, folder, "unrated")
    pages = {"unrated": (None, 1.5), "no distance": (1.0, None)}
    found = [
        paging.page_after(rows, {"rating": rating, "distance": distance, "place_id": 500}, 200).select(F.lit(after).alias("after"), "*")
        for after, (rating, distance) in pages.items()
    ]
    return found[0].unionByName(found[1])


@query(
    "page_info",
    "offers",
    check="""
    SELECT 3 AS page, 20 AS per_page, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, true AS has_prev,
           60 < count(*) AS has_next, 2 AS prev_num, CASE WHEN 60 < count(*) THEN 4 END AS next_num
    FROM offers WHERE price <= 400000""",
)
def page_info(spark, folder) -> DataFrame:
    return paging.page_info(filters.listing_filter(view(spark, folder, "offers"), max_price=400000), 3)


@query(
    "filter_options",
    "places",
    check="""SELECT 'type' AS kind, type AS option FROM places GROUP BY type
             UNION ALL SELECT 'cluster', CAST(cluster AS VARCHAR) FROM places GROUP BY cluster""",
)
def filter_options(spark, folder) -> DataFrame:
    return paging.filter_options(view(spark, folder, "places"))


@query("type_distribution", "places", check="SELECT type, count(*) AS count FROM places GROUP BY type")
def type_distribution(spark, folder) -> DataFrame:
    return statistics.type_distribution(view(spark, folder, "places"))


def _indexed(spark, folder, name: str) -> str:
    """A store with the layouts of a view."""
    store = scratch_folder(spark)
    indexes.write_indexes(view(spark, folder, name), store, range_rows=2_000)
    return store


@query(
    "search_indexed",
    "places",
    check=f"SELECT {ROW} FROM places WHERE contains(lower(name), 'bolt') ORDER BY {BY_RATING} LIMIT 50",
)
def search_indexed(spark, folder) -> DataFrame:
    """The search by name, from the grams of the names."""
    return indexes.search(spark, _indexed(spark, folder, "places"), " Bolt ", limit=50)


@query("lookup_indexed", "offers", check=f"SELECT {ROW} FROM offers WHERE place_id IN (77, 1, 12000)")
def lookup_indexed(spark, folder) -> DataFrame:
    """Lookups in the layout by id."""
    return result_rows(indexes.lookup(spark, _indexed(spark, folder, "offers"), 77, 1, 12000))


@query(
    "list_page_deep",
    "offers",
    check=f"""SELECT *, row_number() OVER (ORDER BY {BY_RATING}) + 5999 AS index FROM
    (SELECT * FROM offers WHERE price <= 400000 ORDER BY {BY_RATING} LIMIT 20 OFFSET 6000)""",
)
def list_page_deep(spark, folder) -> DataFrame:
    """A deep page of the filtered listing, from the ranges of the rating order."""
    return indexes.page(spark, _indexed(spark, folder, "offers"), 301, max_price=400000)
