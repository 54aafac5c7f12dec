"""Catalog: cluster profiles, scores, features, fits and similar places."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster_scores, clustering, features, knn_join, profiles, similar, statistics
from ..operators.kmeans import lloyd, nearest_centre
from ..runtime import scratch_folder
from ..streaming.scoring import assign_stream, write_stream
from .registry import query, rounded
from .views import view

MEASURES = ("price", "rating", "distance")


@query(
    "cluster_profile",
    "offers",
    check="""WITH t AS (SELECT cluster, type, count(*) AS n FROM offers GROUP BY cluster, type),
    m AS (SELECT cluster, type, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, type) AS r FROM t),
    g AS (SELECT cluster, count(*) AS count, avg(price) AS p, avg(rating) AS r, avg(distance) AS d, stddev_samp(price) AS sp,
      stddev_samp(rating) AS sr, stddev_samp(distance) AS sd, min(price) AS p0, max(price) AS p1, min(rating) AS r0,
      max(rating) AS r1 FROM offers GROUP BY cluster)
    SELECT g.cluster, CASE row_number() OVER (ORDER BY p) WHEN 1 THEN 'Ekonomis' WHEN 2 THEN 'Menengah' ELSE 'Premium' END
      AS cluster_name, count, round(count * 100.0 / sum(count) OVER (), 1) AS percentage, round(p, 6) AS avg_price,
      round(g.r, 6) AS avg_rating, round(d, 6) AS avg_distance, round(sp, 6) AS std_price, round(sr, 6) AS std_rating,
      round(sd, 6) AS std_distance, p0 AS min_price, p1 AS max_price, r0 AS min_rating, r1 AS max_rating,
      round(sp / p, 6) AS price_cv, round(sr / g.r, 6) AS rating_cv, round((p1 - p0) / p * 100, 6) AS price_range_pct,
      m.type AS common_type, m.n AS common_count FROM g JOIN m ON g.cluster = m.cluster AND m.r = 1""",
)
def cluster_profile(spark, folder) -> DataFrame:
    profile = profiles.cluster_profile(view(spark, folder, "offers"))
    common = F.element_at("type_distribution", F.col("common_type"))
    return rounded(profile.withColumn("common_count", common).drop("type_distribution"))


@query(
    "cluster_stats",
    "offers",
    check="""WITH g AS (SELECT count(*) AS total, round(avg(price), 6) AS avg_price, round(avg(rating), 6) AS avg_rating,
    round(avg(distance), 6) AS avg_distance, CAST(trunc(min(price)) AS BIGINT) AS low_price,
    CAST(trunc(max(price)) AS BIGINT) AS high_price, min(rating) AS low_rating, max(rating) AS high_rating,
    min(distance) AS low_distance, max(distance) AS high_distance FROM offers WHERE cluster = 1)
    SELECT 1 AS cluster, g.*, type, n FROM g, (SELECT type, count(*) AS n FROM offers WHERE cluster = 1 GROUP BY type)""",
)
def cluster_stats(spark, folder) -> DataFrame:
    one = statistics.cluster_stats(view(spark, folder, "offers"), 1)
    ends = [F.col(f"{c}_range")[k].alias(f"{n}_{c}") for c in MEASURES for n, k in (("low", "min"), ("high", "max"))]
    return rounded(
        one.select("cluster", "total", "avg_price", "avg_rating", "avg_distance", *ends, F.explode("types").alias("type", "n"))
    )


@query("cluster_sizes", "offers", check="SELECT cluster, count(*) AS count FROM offers GROUP BY cluster")
def cluster_sizes(spark, folder) -> DataFrame:
    return profiles.cluster_sizes(view(spark, folder, "offers"))


@query(
    "cluster_names",
    "places",
    check="""SELECT cluster, round(avg(price), 6) AS avg_price, CAST(row_number() OVER (ORDER BY avg(price), cluster) AS INT) AS price_rank,
    CASE row_number() OVER (ORDER BY avg(price), cluster) WHEN 1 THEN 'Ekonomis' WHEN 2 THEN 'Menengah' ELSE 'Premium' END
    AS cluster_name FROM places GROUP BY cluster""",
)
def cluster_names(spark, folder) -> DataFrame:
    return rounded(profiles.cluster_names(view(spark, folder, "places")))


@query(
    "cluster_quality",
    "offers",
    check="""WITH g AS (SELECT cluster, count(*) AS n, avg(price) AS p, avg(rating) AS r, avg(distance) AS d,
      stddev_samp(price) / avg(price) AS cp, stddev_samp(rating) / avg(rating) AS cr, stddev_samp(distance) / avg(distance) AS cd
      FROM offers GROUP BY cluster)
    SELECT CAST(sum(n) AS BIGINT) AS total_samples,
      round(greatest(0, least(1, 1 - stddev_pop(n) / (sum(n) / count(*)))), 6) AS balance_score,
      round(least(1, stddev_pop(p) / avg(p)), 6) AS price_separation, round(greatest(0, 1 - avg(cp)), 6) AS homogeneity_price,
      round(greatest(0, 1 - avg(cr)), 6) AS homogeneity_rating, round(greatest(0, 1 - avg(cd)), 6) AS homogeneity_distance FROM g""",
)
def cluster_quality(spark, folder) -> DataFrame:
    return rounded(profiles.cluster_quality(view(spark, folder, "offers")))


LONG = """WITH x AS (SELECT place_id, cluster, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM vectors),
    c AS (SELECT cluster, i, avg(v) AS mu, var_pop(v) AS var, count(*) AS n FROM x GROUP BY cluster, i)"""


@query("inertia", "vectors", check=f"{LONG} SELECT round(sum(n * var), 6) AS inertia FROM c")
def inertia(spark, folder) -> DataFrame:
    return rounded(cluster_scores.inertia(view(spark, folder, "vectors"), "embedding"))


@query(
    "ch_score",
    "vectors",
    check=f"""{LONG}, g AS (SELECT i, sum(n * mu) / sum(n) AS m FROM c GROUP BY i),
    s AS (SELECT sum(n * (mu - m) ** 2) AS b, sum(n * var) AS w FROM c JOIN g USING (i)),
    k AS (SELECT count(DISTINCT cluster) AS k, count(*) AS n FROM vectors)
    SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM s, k""",
)
def ch_score(spark, folder) -> DataFrame:
    return rounded(cluster_scores.calinski_harabasz(view(spark, folder, "vectors"), "embedding"))


@query(
    "db_score",
    "vectors",
    check=f"""{LONG}, d AS (SELECT place_id, x.cluster, sqrt(sum((v - mu) ** 2)) AS gap FROM x JOIN c
      ON x.cluster = c.cluster AND x.i = c.i GROUP BY place_id, x.cluster),
    s AS (SELECT cluster, avg(gap) AS s FROM d GROUP BY cluster),
    p AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum((a.mu - b.mu) ** 2)) AS m FROM c a JOIN c b ON a.i = b.i
      AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
    r AS (SELECT p.a, max((sa.s + sb.s) / m) AS r FROM p JOIN s sa ON sa.cluster = p.a JOIN s sb ON sb.cluster = p.b GROUP BY p.a)
    SELECT round(avg(r), 6) AS davies_bouldin FROM r""",
)
def db_score(spark, folder) -> DataFrame:
    return rounded(cluster_scores.davies_bouldin(view(spark, folder, "vectors"), "embedding"))


@query(
    "silhouette",
    "vectors",
    check="""WITH v AS (SELECT place_id, cluster, embedding::DOUBLE[] AS e FROM vectors),
    d AS (SELECT a.place_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n
      FROM v a, v b GROUP BY a.place_id, a.cluster, b.cluster),
    p AS (SELECT place_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS inside,
      min(CASE WHEN own <> other THEN s / n END) AS outside FROM d GROUP BY place_id)
    SELECT 'cluster' AS labeling, round(avg(coalesce((outside - inside) / greatest(inside, outside), 0)), 6) AS silhouette FROM p""",
)
def silhouette(spark, folder) -> DataFrame:
    return rounded(cluster_scores.euclidean_silhouette(view(spark, folder, "vectors"), "embedding", ["cluster"]))


CODED = """WITH t AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS code FROM (SELECT DISTINCT type FROM places)),
    f AS (SELECT place_id, price, rating, distance, code::DOUBLE AS code FROM places JOIN t USING (type))"""


@query(
    "feature_scaling",
    "places",
    check=CODED
    + """, m AS (SELECT avg(price) p, stddev_pop(price) sp, avg(rating) r, stddev_pop(rating) sr, avg(distance) d,
      stddev_pop(distance) sd, avg(code) c, stddev_pop(code) sc, median(price) mp,
      quantile_cont(price, 0.75) - quantile_cont(price, 0.25) qp, median(code) mc,
      quantile_cont(code, 0.75) - quantile_cont(code, 0.25) qc FROM f)
    SELECT place_id, code AS type_encoded, round((price - p) / sp, 6) AS price_scaled, round((rating - r) / sr, 6) AS rating_scaled,
      round((distance - d) / sd, 6) AS distance_scaled, round((code - c) / sc, 6) AS type_scaled,
      round((price - mp) / qp, 6) AS price_robust, round((code - mc) / qc, 6) AS type_robust FROM f, m""",
)
def feature_scaling(spark, folder) -> DataFrame:
    rows = features.with_features(view(spark, folder, "places"))
    names = ("price_scaled", "rating_scaled", "distance_scaled", "type_scaled")
    scaled = [c.alias(n) for c, n in zip(features.standardised(rows), names)]
    robust = features.robust_scaled(rows, ["price", features.TYPE_CODE])
    return rounded(
        rows.select("place_id", features.TYPE_CODE, *scaled, robust[0].alias("price_robust"), robust[1].alias("type_robust"))
    )


SCALED = (
    CODED
    + """, m AS (SELECT avg(price) p, stddev_pop(price) sp, avg(rating) r, stddev_pop(rating) sr, avg(distance) d,
      stddev_pop(distance) sd, avg(code) c, stddev_pop(code) sc FROM f),
    z AS (SELECT place_id, [(price - p) / sp, (rating - r) / sr, (distance - d) / sd, (code - c) / sc] AS v FROM f, m)"""
)


@query(
    "similar_items",
    "places",
    check=SCALED
    + """, s AS (SELECT b.place_id, list_cosine_similarity(a.v, b.v) AS score FROM z a, z b
      WHERE a.place_id = 42 AND b.place_id <> 42 ORDER BY round(score, 9) DESC, b.place_id LIMIT 5)
    SELECT place_id, name, type, CAST(trunc(price) AS BIGINT) AS price, rating, distance, location, cluster,
      round(score, 6) AS similarity_score FROM s JOIN places USING (place_id)""",
)
def similar_items(spark, folder) -> DataFrame:
    return rounded(similar.similar_places(view(spark, folder, "places"), 42, digits=9), "similarity_score")


@query(
    "similar_vectors",
    "vectors",
    check="""SELECT b.place_id, b.cluster, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity_score
    FROM vectors a, vectors b WHERE a.place_id = 7 AND b.place_id <> 7
    ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.place_id LIMIT 10""",
)
def similar_vectors(spark, folder) -> DataFrame:
    vectors = view(spark, folder, "vectors").withColumn("vector", F.col("embedding").cast("array<double>"))
    width = cluster_scores.dimensions(vectors, "vector")
    return rounded(similar.nearest_to(vectors, 7, 10, width).select("place_id", "cluster", "similarity_score"))


@query(
    "item_detail",
    "places",
    check=SCALED
    + """, s AS (SELECT b.place_id, list_cosine_similarity(a.v, b.v) AS score FROM z a, z b
      WHERE a.place_id = 42 AND b.place_id <> 42 ORDER BY round(score, 9) DESC, b.place_id LIMIT 5),
    r AS (SELECT 0 AS rank, 42 AS place_id, NULL AS score
          UNION ALL SELECT row_number() OVER (ORDER BY round(score, 9) DESC, place_id), place_id, score FROM s),
    g AS (SELECT cluster, count(*) AS cluster_count, round(avg(price), 6) AS cluster_avg_price,
          CASE row_number() OVER (ORDER BY avg(price)) WHEN 1 THEN 'Ekonomis' WHEN 2 THEN 'Menengah' ELSE 'Premium' END AS cluster_name
          FROM places GROUP BY cluster)
    SELECT CAST(rank AS INT) AS rank, place_id, name, CAST(trunc(price) AS BIGINT) AS price, cluster, cluster_name, cluster_count,
      cluster_avg_price, round(score, 6) AS similarity_score FROM r JOIN places USING (place_id) JOIN g USING (cluster)""",
)
def item_detail(spark, folder) -> DataFrame:
    detail = similar.place_detail(view(spark, folder, "places"), 42)
    return rounded(
        detail.select(
            "rank", "place_id", "name", "price", "cluster", "cluster_name", "cluster_count", "cluster_avg_price", "similarity_score"
        )
    )


@query(
    "similar_topk_all",
    "places",
    check=SCALED
    + """, s AS (SELECT a.place_id AS place_id, b.place_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 9) AS score
      FROM z a JOIN z b ON a.place_id <> b.place_id),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, neighbour) AS rank FROM s)
    SELECT place_id, CAST(rank AS INT) AS rank, neighbour, round(score, 6) AS similarity FROM r WHERE rank <= 5""",
)
def similar_topk_all(spark, folder) -> DataFrame:
    return rounded(knn_join.similar_for_all(view(spark, folder, "places"), 5))


# Given centres, in scaled price, rating, distance and type, and steps from them.
GIVEN = [[-1.1, -0.7, -0.9, -0.3], [0.2, 0.1, -0.2, 0.4], [1.3, 0.8, 0.9, 0.6]]
PASSES = 4


def _steps_sql() -> str:
    parts = [SCALED, f"c0 AS (SELECT unnest([0, 1, 2]) AS cluster, unnest({GIVEN}) AS c)"]
    for n in range(PASSES + 1):
        parts.append(f"""a{n} AS (SELECT place_id, v, cluster, gap FROM (SELECT place_id, v, cluster, list_distance(v, c) ^ 2 AS gap,
          row_number() OVER (PARTITION BY place_id ORDER BY list_distance(v, c), cluster) AS r FROM z, c{n}) WHERE r = 1)""")
        if n < PASSES:
            parts.append(f"c{n + 1} AS (SELECT cluster, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS c FROM a{n} GROUP BY cluster)")
    return ", ".join(parts)


def _steps(spark, folder) -> tuple[DataFrame, list[list[float]]]:
    rows = features.with_features(view(spark, folder, "places"))
    points = rows.select("place_id", F.array(*features.standardised(rows)).alias("point"))
    return points, lloyd(points.select("point"), GIVEN, PASSES).tolist()


@query("kmeans_steps", "places", check=_steps_sql() + f" SELECT place_id, CAST(cluster AS INT) AS cluster FROM a{PASSES}")
def kmeans_steps(spark, folder) -> DataFrame:
    """Clusters after some steps from given centres."""
    points, centres = _steps(spark, folder)
    return points.select("place_id", nearest_centre(F.col("point"), centres).alias("cluster"))


@query(
    "kmeans_steps_inertia",
    "places",
    check=_steps_sql() + f" SELECT CAST(cluster AS INT) AS cluster, count(*) AS count, round(sum(gap), 4) AS inertia FROM a{PASSES} GROUP BY cluster",
)
def kmeans_steps_inertia(spark, folder) -> DataFrame:
    """Size and cost of each cluster after those steps."""
    points, centres = _steps(spark, folder)
    cluster = nearest_centre(F.col("point"), centres)
    all_centres = F.array(*[F.array(*map(F.lit, c)) for c in centres])
    gap = F.aggregate(F.zip_with("point", F.get(all_centres, cluster), lambda x, y: (x - y) ** 2), F.lit(0.0), lambda a, x: a + x)
    placed = points.select(cluster.alias("cluster"), gap.alias("gap"))
    return placed.groupBy("cluster").agg(F.count("*").alias("count"), F.round(F.sum("gap"), 4).alias("inertia"))


@query(
    "kmeans_steps_importance",
    "places",
    check=_steps_sql()
    + f""", s AS (SELECT unnest(['price', 'rating', 'distance', 'type_encoded']) AS feature,
      unnest([var_pop(c[1]), var_pop(c[2]), var_pop(c[3]), var_pop(c[4])]) AS v FROM c{PASSES})
    SELECT feature, round(v / sum(v) OVER (), 6) AS importance FROM s""",
)
def kmeans_steps_importance(spark, folder) -> DataFrame:
    """Share of each feature in the variance of those centres."""
    return rounded(clustering.centre_importance(_steps(spark, folder)[1]))


def _fit(spark, folder, **options):
    places = view(spark, folder, "places").drop("cluster")
    return places, clustering.fit_clusters(places, **{"k": 3, **options})


@query("kmeans_assign")
def kmeans_assign(spark, folder) -> DataFrame:
    _, (model, assigned) = _fit(spark, folder, silhouette=None)
    return clustering.name_clusters(assigned, model.info.k)


@query("kmeans_report")
def kmeans_report(spark, folder) -> DataFrame:
    _, (model, _) = _fit(spark, folder)
    facts = {"k": model.info.k, "rows": model.info.rows, "inertia": model.info.inertia, **model.info.metrics}
    return spark.createDataFrame([(name, float(value)) for name, value in facts.items()], "metric string, value double")


@query("auto_k")
def auto_k(spark, folder) -> DataFrame:
    places, _ = clustering.prepare(view(spark, folder, "places").drop("cluster"))
    return clustering.search_k(places, max_k=clustering.LARGEST_K)


@query("feature_importance")
def feature_importance(spark, folder) -> DataFrame:
    _, (model, _) = _fit(spark, folder, silhouette=None)
    return model.feature_importance()


#: Each place's nearest given centre, scaled as the fitted stages do, by the sample deviation.
NEAREST = (
    SCALED.replace("stddev_pop", "stddev_samp")
    + f""", g AS (SELECT unnest([0, 1, 2]) AS cluster, unnest({GIVEN}) AS c),
    near AS (SELECT place_id, cluster FROM (SELECT place_id, cluster, row_number() OVER (PARTITION BY place_id ORDER BY list_distance(v, c), cluster) AS r
      FROM z, g) WHERE r = 1)"""
)


def _given_model(spark, folder) -> tuple[DataFrame, clustering.ClusterModel]:
    """A model with the given centres, saved and loaded."""
    places = view(spark, folder, "places").drop("cluster")
    path = scratch_folder(spark)
    clustering.from_centres(places, GIVEN).save(path)
    return places, clustering.ClusterModel.load(path)


@query("predict_given", "places", check=NEAREST + " SELECT place_id, CAST(cluster AS INT) AS cluster FROM near")
def predict_given(spark, folder) -> DataFrame:
    """Places assigned by a saved and loaded model."""
    places, model = _given_model(spark, folder)
    return model.assign(places).select("place_id", "cluster")


@query(
    "stored_model",
    "places",
    check=NEAREST
    + f""", gaps AS (SELECT min(list_distance(v, c) ^ 2) AS gap FROM z, g GROUP BY place_id),
    fit AS (SELECT count(*) AS n, sum(gap) AS cost FROM gaps),
    spread AS (SELECT unnest([var_pop(c[1]), var_pop(c[2]), var_pop(c[3]), var_pop(c[4])]) AS x FROM g)
    SELECT 'k' AS fact, 3.0::DOUBLE AS value UNION ALL SELECT 'rows', n FROM fit UNION ALL SELECT 'inertia', round(cost * n / (n - 1), 4) FROM fit
    UNION ALL SELECT 'largest importance', round(max(x) / sum(x), 6) FROM spread""",
)
def stored_model(spark, folder) -> DataFrame:
    """What a loaded model knows of itself."""
    _, model = _given_model(spark, folder)
    facts = spark.createDataFrame([("k", float(model.info.k)), ("rows", float(model.info.rows)), ("inertia", round(model.info.inertia, 4))], "fact string, value double")
    top = model.feature_importance().agg(F.round(F.max("importance"), 6).alias("value"))
    return facts.unionByName(top.select(F.lit("largest importance").alias("fact"), "value"))


@query(
    "stream_given",
    "places",
    check=NEAREST
    + """, n AS (SELECT cluster, CASE row_number() OVER (ORDER BY avg(price), cluster) WHEN 1 THEN 'Ekonomis' WHEN 2 THEN 'Menengah' ELSE 'Premium' END
      AS cluster_name FROM near JOIN (SELECT place_id, price FROM places) USING (place_id) GROUP BY cluster)
    SELECT place_id, CAST(cluster AS INT) AS cluster, cluster_name FROM near JOIN n USING (cluster)""",
)
def stream_given(spark, folder) -> DataFrame:
    """The same places as a stream, assigned by the loaded model and read back."""
    places, model = _given_model(spark, folder)
    return _streamed(spark, model, places, model.assign(places)).select("place_id", "cluster", "cluster_name")


def _streamed(spark, model: clustering.ClusterModel, places: DataFrame, assigned: DataFrame) -> DataFrame:
    base = scratch_folder(spark)
    places.write.parquet(f"{base}/in")
    names = {r["cluster"]: r["cluster_name"] for r in profiles.cluster_names(assigned).collect()}
    stream = spark.readStream.schema(places.schema).parquet(f"{base}/in")
    write_stream(assign_stream(model, stream, names), f"{base}/out", f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("predict_new")
def predict_new(spark, folder) -> DataFrame:
    """Save a fitted model, load it, and assign all places with frozen fences."""
    places, (model, _) = _fit(spark, folder, silhouette=None)
    path = scratch_folder(spark)
    model.save(path)
    return clustering.ClusterModel.load(path).assign(places, outliers="frozen")


@query("stream_assign")
def stream_assign(spark, folder) -> DataFrame:
    """Assign the same places as a stream and read back what it wrote."""
    places, (model, assigned) = _fit(spark, folder, silhouette=None)
    return _streamed(spark, model, places, assigned)
