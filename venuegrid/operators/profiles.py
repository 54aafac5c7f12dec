"""What clusters look like. Tables are grouped by cluster at once; everything
after that works on a handful of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small
from ..schema import CLUSTER_LABELS, MEASURES
from .statistics import type_map


def _label(rank: Column, k: Column) -> Column:
    """Label of the 1-based price rank among ``k`` clusters."""
    out = None
    for size, labels in CLUSTER_LABELS.items():
        named = F.get(F.array(*[F.lit(x) for x in labels]), rank - 1)
        out = F.when(k == size, named) if out is None else out.when(k == size, named)
    out = out.otherwise(F.when(rank <= k, F.concat(F.lit("Kategori "), rank.cast("string"))))
    return F.coalesce(out, F.concat(F.lit("Cluster "), (rank - 1).cast("string")))


def cluster_names(df: DataFrame, k: int | None = None) -> DataFrame:
    """One row per cluster with its name; the cheapest cluster comes first.
    ``k`` is the number of clusters asked for, if some may be empty."""
    means = df.groupBy("cluster").agg(F.avg("price").alias("avg_price"))
    rank = F.row_number().over(Window.orderBy("avg_price", "cluster"))
    count = F.lit(k) if k is not None else F.count("*").over(Window.partitionBy())
    ranked = means.withColumn("price_rank", rank).withColumn("k", count)
    return ranked.select("cluster", "avg_price", "price_rank", _label(F.col("price_rank"), F.col("k")).alias("cluster_name"))


def with_cluster_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Look the name up; clusters without one are called by their number."""
    known = broadcast_if_small(names.select("cluster", "cluster_name"))
    fallback = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    return df.join(known, "cluster", "left").withColumn("cluster_name", F.coalesce("cluster_name", fallback))


def _cv(c: str) -> Column:
    return F.when(F.col(f"avg_{c}") > 0, F.col(f"std_{c}") / F.col(f"avg_{c}")).otherwise(F.lit(0.0))


def cluster_profile(df: DataFrame, k: int | None = None) -> DataFrame:
    """One row per non-empty cluster, cheapest first."""
    parts = [F.count("*").alias("count")]
    for c in MEASURES:
        parts += [F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    for c in ("price", "rating"):
        parts += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    stats = df.groupBy("cluster").agg(*parts)
    per_type = df.groupBy("cluster", "type").agg(F.count("*").alias("n"))
    commonest = F.min(F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("minus"), "type")))["type"]
    types = per_type.groupBy("cluster").agg(commonest.alias("common_type"), type_map().alias("type_distribution"))

    rank = F.row_number().over(Window.orderBy("avg_price", "cluster"))
    everything = Window.partitionBy()
    ranked = (
        stats.join(types, "cluster")
        .withColumn("price_rank", rank)
        .withColumn("k", F.lit(k) if k is not None else F.count("*").over(everything))
        .withColumn("total", F.sum("count").over(everything))
    )
    spread = F.col("max_price") - F.col("min_price")
    return ranked.select(
        "cluster",
        _label(F.col("price_rank"), F.col("k")).alias("cluster_name"),
        "count",
        F.round(F.col("count") / F.col("total") * 100, 1).alias("percentage"),
        *[f"avg_{c}" for c in MEASURES],
        *[f"std_{c}" for c in MEASURES],
        "min_price",
        "max_price",
        "min_rating",
        "max_rating",
        _cv("price").alias("price_cv"),
        _cv("rating").alias("rating_cv"),
        F.when(F.col("avg_price") > 0, spread / F.col("avg_price") * 100).otherwise(F.lit(0.0)).alias("price_range_pct"),
        F.coalesce("common_type", F.lit("Mixed")).alias("common_type"),
        "type_distribution",
    ).orderBy("avg_price", "cluster")


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("count")).orderBy("cluster")


def cluster_quality(df: DataFrame, k: int | None = None) -> DataFrame:
    """One row: balance of sizes, separation of mean prices, and homogeneity of
    each measure, all from one pass over the places."""
    per_cluster = df.groupBy("cluster").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"avg_{c}") for c in MEASURES],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in MEASURES],
    )
    cv = lambda c: F.when(F.col("n") > 1, F.try_divide(F.col(f"std_{c}"), F.col(f"avg_{c}")))
    one = per_cluster.agg(
        F.sum("n").alias("total_samples"),
        F.count("*").alias("filled"),
        F.stddev_pop("n").alias("size_std"),
        F.stddev_pop("avg_price").alias("price_std"),
        F.avg("avg_price").alias("price_mean"),
        *[F.coalesce(F.avg(cv(c)), F.lit(1.0)).alias(f"cv_{c}") for c in MEASURES],
    )
    clusters = F.col("filled") if k is None else F.lit(k)
    balance = F.lit(1.0) - F.col("size_std") / (F.col("total_samples") / clusters)
    separation = F.least(F.lit(1.0), F.try_divide(F.col("price_std"), F.col("price_mean")))
    return one.select(
        "total_samples",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), balance)).alias("balance_score"),
        F.when(F.col("filled") < 2, F.lit(0.0)).otherwise(separation).alias("price_separation"),
        *[F.greatest(F.lit(0.0), F.lit(1.0) - F.col(f"cv_{c}")).alias(f"homogeneity_{c}") for c in MEASURES],
    )
