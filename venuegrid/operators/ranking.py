"""Scores, orders and limits.

Orders end with the row id, so that results do not depend on partitioning.
``orderBy`` followed by ``limit`` plans as a per-partition top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ID, MEASURES

DEFAULT_LIMIT = 10
MAX_LIMIT = 50

# Weights of the two combined scores.
HYBRID_WEIGHTS = {"rating": 0.4, "distance": 0.35, "price": 0.25}
PERSONAL_WEIGHTS = {"price": 0.3, "distance": 0.3, "rating": 0.4}
PERSONAL_EPSILON = 1e-8


def order_for(sort_by: str) -> list[Column]:
    """Sort keys of a named order; unknown names keep the input order."""
    best_rating = F.col("rating").desc_nulls_last()
    near, cheap = (F.col(c).asc_nulls_last() for c in ("distance", "price"))
    orders = {
        "rating": [best_rating, near],
        "distance": [near, best_rating],
        "price": [cheap, best_rating],
        "hybrid": [F.col("hybrid_score").desc_nulls_last()],
        "personalized": [F.col("personalized_score").desc_nulls_last()],
    }
    return orders.get(sort_by, []) + [F.col(ID).asc()]


def top(df: DataFrame, sort_by: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return df.orderBy(*order_for(sort_by)).limit(limit)


def capped(limit: int | None) -> int:
    return min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT)


def _extremes(df: DataFrame) -> Column:
    """Smallest and largest value of each measure, as a scalar subquery: one
    partially aggregated pass, no join, no window over the whole table."""
    ends = [f(c).alias(f"{n}_{c}") for c in MEASURES for n, f in (("low", F.min), ("high", F.max))]
    return df.agg(F.struct(*ends).alias("ends")).scalar()


def with_hybrid_score(df: DataFrame, weights: dict | None = None, constant: float | None = None) -> DataFrame:
    """Weighted sum of min-max positions within ``df``: high rating, short
    distance, low price. A measure without spread has no position, which makes
    the score null, unless ``constant`` says what to use instead."""
    w = {**HYBRID_WEIGHTS, **(weights or {})}
    ends = _extremes(df)

    def position(c: str) -> Column:
        low, high = ends[f"low_{c}"], ends[f"high_{c}"]
        p = F.try_divide(F.col(c) - low, (high - low).cast("double"))
        return p if constant is None else F.coalesce(p, F.lit(float(constant)))

    score = (
        F.lit(w["rating"]) * position("rating")
        + F.lit(w["distance"]) * (F.lit(1.0) - position("distance"))
        + F.lit(w["price"]) * (F.lit(1.0) - position("price"))
    )
    return df.withColumn("hybrid_score", score)


def with_personalized_score(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """As the hybrid score, with a tiny constant that keeps divisors positive."""
    w = {**PERSONAL_WEIGHTS, **(weights or {})}
    ends = _extremes(df)

    def position(c: str) -> Column:
        low, high = ends[f"low_{c}"], ends[f"high_{c}"]
        return (F.col(c) - low) / (high - low + F.lit(PERSONAL_EPSILON))

    score = (
        F.lit(float(w["price"])) * (F.lit(1.0) - position("price"))
        + F.lit(float(w["distance"])) * (F.lit(1.0) - position("distance"))
        + F.lit(float(w["rating"])) * position("rating")
    )
    return df.withColumn("personalized_score", score)
