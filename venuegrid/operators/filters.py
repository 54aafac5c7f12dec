"""Predicates. Each builds one conjunction of Columns, so that Catalyst can
push it into the scan; an absent parameter adds no predicate."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text, in_text_list, same_text
from ..schema import ID

# The choices offered for quick filtering.
PRESETS = {
    "ekonomis": {"cluster_name": "ekonomis"},
    "menengah": {"cluster_name": "menengah"},
    "premium": {"cluster_name": "premium"},
    "ekonomis-menengah": {"cluster_names": "ekonomis,menengah"},
    "menengah-premium": {"cluster_names": "menengah,premium"},
    "budget-friendly": {"max_price": 15000},
    "mid-range": {"min_price": 15000, "max_price": 30000},
    "expensive": {"min_price": 30000},
}


def preset(choice: str | int) -> dict:
    """Filter parameters behind a named choice; other choices are cluster ids."""
    return dict(PRESETS.get(str(choice)) or {"cluster_id": int(choice)})


def keep(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return df.where(reduce(and_, predicates)) if predicates else df


def _bounds(df, min_price=None, max_price=None, min_rating=None, max_rating=None, min_distance=None, max_distance=None):
    """One predicate for each limit given; a limit on an absent column is an error."""
    lows = {"price": min_price, "rating": min_rating, "distance": min_distance}
    highs = {"price": max_price, "rating": max_rating, "distance": max_distance}
    found = [_present(df, c) >= F.lit(v) for c, v in lows.items() if v is not None]
    return found + [_present(df, c) <= F.lit(v) for c, v in highs.items() if v is not None]


def _present(df: DataFrame, column: str) -> Column:
    if column not in df.columns:
        raise ValueError(f"no column {column} to filter by")
    return F.col(column)


def filter_places(df: DataFrame, *, type=None, regex: bool = False, **limits) -> DataFrame:
    """Ranges over the three measures, and a type given as a list (membership)
    or a text (containment)."""
    found = _bounds(df, **limits)
    if type:
        member = isinstance(type, (list, tuple, set))
        found.append(F.col("type").isin(list(type)) if member else contains_text("type", type, regex))
    return keep(df, found)


def recommendation_filter(
    df: DataFrame,
    *,
    min_price=None,
    max_price=None,
    max_distance=None,
    min_rating=None,
    type: str | None = None,
    cluster_id: int | None = None,
    cluster_name: str | None = None,
    cluster_names: str | None = None,
    regex: bool = False,
) -> DataFrame:
    """Filter of the recommendation queries; cluster names compare without case."""
    found = _bounds(
        df, min_price=min_price, max_price=max_price, max_distance=max_distance, min_rating=min_rating
    )
    if type:
        found.append(contains_text("type", type, regex))
    if cluster_id is not None:
        found.append(F.col("cluster") == F.lit(cluster_id))
    if cluster_name or cluster_names:
        _present(df, "cluster_name")
    if cluster_name:
        found.append(same_text("cluster_name", cluster_name))
    if cluster_names:
        found.append(in_text_list("cluster_name", cluster_names))
    return keep(df, found)


def preference_filter(
    df: DataFrame, *, price_range=(0, float("inf")), max_distance=float("inf"), min_rating=0, types=()
) -> DataFrame:
    """Hard constraints of a personal profile; infinite limits add nothing."""
    finite = {
        k: v
        for k, v in (
            ("min_price", price_range[0]),
            ("max_price", price_range[1]),
            ("max_distance", max_distance),
            ("min_rating", min_rating),
        )
        if v not in (float("inf"), float("-inf"))
    }
    found = _bounds(df, **finite)
    if types:
        found.append(F.col("type").isin(list(types)))
    return keep(df, found)


def diverse_filter(df: DataFrame, *, max_price=None, max_distance=None, min_rating=None) -> DataFrame:
    """Like the other filters, but here zero also means "no limit"."""
    return keep(
        df,
        _bounds(df, max_price=max_price or None, max_distance=max_distance or None, min_rating=min_rating or None),
    )


def listing_filter(
    df: DataFrame, *, max_price=None, max_distance=None, min_rating=None, type=None, cluster_id=None, regex=False
) -> DataFrame:
    """Filter of the paged listing; limits on absent columns are ignored."""
    limits = {"price": ("max_price", max_price), "distance": ("max_distance", max_distance), "rating": ("min_rating", min_rating)}
    found = _bounds(df, **dict(limit for c, limit in limits.items() if c in df.columns))
    if type and "type" in df.columns:
        found.append(contains_text("type", type, regex))
    if cluster_id is not None and "cluster" in df.columns:
        found.append(F.col("cluster") == F.lit(cluster_id))
    return keep(df, found)


def member_of(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose value is in a table of values; a null value never is."""
    return df.join(listed.select(column).distinct(), column, "left_semi")


def search_name(df: DataFrame, query: str, regex: bool = False) -> DataFrame:
    query = (query or "").strip()
    if not query:
        raise ValueError("a search needs some text")
    return df.where(contains_text("name", query, regex))


def of_cluster(df: DataFrame, cluster_id: int) -> DataFrame:
    return df.where(F.col("cluster") == F.lit(cluster_id))


def by_id(df: DataFrame, place_id: int) -> DataFrame:
    return df.where(F.col(ID) == F.lit(place_id))
