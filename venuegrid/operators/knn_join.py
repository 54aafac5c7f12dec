"""Most similar places for every place: an exact cosine nearest-neighbour join.

A Voronoi-partitioned kNN join (a published technique), adapted to cosine.
Directions are assigned to the nearest of a few pivots. For a query q of length
one and any x in a cell with pivot p, the angle of q and x is at least that of q and p
less the cell's radius, the largest angle of a member and p. A cell is visited only if
the cosine of that reaches the k-th best score q already has from its own block. Where
there are no angles, as a vector has no length, ``q.x <= q.p + |x - p|`` bounds the score. Cells are cut into blocks of limited size, and scores are computed
block against block, so nothing depends on how rows are spread over cells.

Places with equal features are merged first. Of each such group only the k + 1
smallest ids can be among anyone's k best, since ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise
from ..schema import ID
from .features import standardised, with_features

BLOCK_VECTORS = 1_024
MOST_PIVOTS = 16_384
MATRIX_CELLS = 4_000_000
DIGITS = 9
SLACK = 1e-6


def _unit(vector: str) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, dtype=float) for r in rows])


def _nearest_pivot(pivots: np.ndarray):
    step = max(1, MATRIX_CELLS // len(pivots))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch)
            cells, gaps = [], []
            for start in range(0, len(x), step):
                part = x[start : start + step]
                apart = np.zeros((len(part), len(pivots)))
                for d in range(pivots.shape[1]):
                    apart += (part[:, d, None] - pivots[None, :, d]) ** 2
                cell = apart.argmin(axis=1)
                cells.append(cell)
                gaps.append(np.sqrt(apart[np.arange(len(part)), cell]))
            yield pd.DataFrame({"cell": np.concatenate(cells), "gap": np.concatenate(gaps)})

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """Per row the k best columns by rounded score, the smaller id on ties. ``ids`` ascend."""
    rounded = np.round(scores, DIGITS)
    if rounded.shape[1] <= k:
        order = np.argsort(-rounded, axis=1, kind="stable")
        return np.take_along_axis(rounded, order, axis=1), ids[order]
    least = np.partition(rounded, rounded.shape[1] - k, axis=1)[:, -k]
    # All above the k-th best score, and of its ties the first ones.
    above, tied = rounded > least[:, None], rounded == least[:, None]
    keep = above | (tied & (tied.cumsum(axis=1, dtype=np.int32) <= (k - above.sum(axis=1))[:, None]))
    columns = np.nonzero(keep)[1].reshape(len(rounded), k)
    best = np.take_along_axis(rounded, columns, axis=1)
    order = np.argsort(-best, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), ids[np.take_along_axis(columns, order, axis=1)]


def _has_direction(x: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1) > 0.5


def _reached(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which cells may hold a vector that scores ``floor`` or more with each x. Vectors without
    length score 0, so above that the angle counts; without length x and pivots have none."""
    cosines = x @ pivots.T
    by_gap = cosines + radii[None, :] >= floor[:, None] - SLACK
    angles = 2.0 * np.arcsin(np.clip(radii / 2.0, 0.0, 1.0))
    apart = np.arccos(np.clip(cosines, -1.0, 1.0)) - angles[None, :]
    by_angle = np.cos(np.maximum(apart, 0.0)) >= floor[:, None] - SLACK
    no_angle = (floor <= SLACK) | ~_has_direction(x)
    return by_gap & (by_angle | no_angle[:, None] | ~_has_direction(pivots)[None, :])


def _own_block(k: int, pivots: np.ndarray, radii: np.ndarray):
    """Scores inside a block, and which other cells each member has to see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, qids = _matrix(row.queries), np.asarray(row.query_ids)
                y, ids = _matrix(row.vectors), np.asarray(row.ids)
                best, found = _best(x @ y.T, ids, k)
                floor = best[:, -1] if best.shape[1] == k else np.full(len(x), -2.0)
                reach = _reached(x, pivots, radii, floor)
                yield pd.DataFrame(
                    {
                        "block": row.block,
                        "cell": row.cell,
                        "query": qids,
                        "vector": list(x),
                        "scores": list(best),
                        "ids": list(found),
                        "cells": [np.flatnonzero(r) for r in reach],
                    }
                )

    return run


def _other_block(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                best, found = _best(_matrix(row.queries) @ _matrix(row.vectors).T, np.asarray(row.ids), k)
                yield pd.DataFrame({"query": np.asarray(row.query_ids), "scores": list(best), "ids": list(found)})

    return run


def nearest_for_all(
    vectors: DataFrame, k: int, block_vectors: int = BLOCK_VECTORS, pivots: int | None = None
) -> DataFrame:
    """The ``k`` nearest other rows of every row of (id, vector), as
    (id, rank, neighbour, similarity)."""
    keyed = materialise(vectors.select(ID, _unit("vector").alias("unit")))
    first = F.row_number().over(Window.partitionBy("unit").orderBy(ID))
    lowest = keyed.withColumn("nth", first).where(F.col("nth") <= k + 1)
    groups = lowest.groupBy("unit").agg(F.array_sort(F.collect_list(ID)).alias("ids"))
    groups = materialise(groups.withColumn("query", F.get("ids", F.lit(0))))

    n = groups.count()
    if n == 0:
        return keyed.select(ID, F.lit(1).alias("rank"), F.col(ID).alias("neighbour"), F.lit(0.0).alias("similarity")).limit(0)
    wanted = min(pivots or max(1, int((n / 4) ** 0.5)), MOST_PIVOTS)
    chosen = groups.orderBy(F.xxhash64("unit"), "query").limit(wanted)
    # A bounded number of short vectors goes to the driver and out with the plan.
    centre = _matrix([r["unit"] for r in chosen.select("unit").collect()])

    assign = F.pandas_udf(_nearest_pivot(centre), "cell int, gap double")
    placed = materialise(groups.withColumn("place", assign("unit")).select("query", "ids", "unit", "place.cell", "place.gap"))
    sizes = placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.sum(F.size("ids")).alias("held"))
    radii = np.full(len(centre), -np.inf)
    for r in sizes.collect():
        radii[r["cell"]] = r["radius"]

    parts = F.greatest(F.lit(1), F.ceil(F.col("held") / F.lit(block_vectors))).cast("int")
    cut = placed.join(F.broadcast(sizes.select("cell", parts.alias("parts"))), "cell").withColumn(
        "part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")
    )
    member = F.struct("query", "unit", "ids")
    blocks = cut.groupBy("cell", "part").agg(F.array_sort(F.collect_list(member)).alias("m"))
    flat = F.array_sort(
        F.flatten(F.transform("m", lambda e: F.transform(e["ids"], lambda i: F.struct(i.alias("id"), e["unit"].alias("u")))))
    )
    packed = materialise(
        blocks.withColumn("flat", flat).select(
            F.struct("cell", "part").alias("key"),
            "cell",
            F.col("m.query").alias("query_ids"),
            F.col("m.unit").alias("queries"),
            F.col("flat.id").alias("ids"),
            F.col("flat.u").alias("vectors"),
        )
    )
    block_id = F.xxhash64("key")
    lists = "query long, scores array<double>, ids array<long>"
    own = materialise(
        packed.select(block_id.alias("block"), "cell", "query_ids", "queries", "ids", "vectors").mapInPandas(
            _own_block(k + 1, centre, radii),
            "block long, cell int, query long, vector array<double>, scores array<double>, ids array<long>, cells array<int>",
        )
    )
    # Queries travel in groups of at most one block to every cell they must see.
    visits = (
        own.select("block", "query", "vector", F.explode("cells").alias("target"))
        .groupBy("block", "target")
        .agg(F.collect_list(F.struct("query", "vector")).alias("q"))
        .select("block", "target", F.col("q.query").alias("query_ids"), F.col("q.vector").alias("queries"))
    )
    # A visit goes to each block of its cell by itself, so that a dense cell is no hot key.
    held = F.broadcast(sizes.select(F.col("cell").alias("target"), parts.alias("parts")))
    visits = visits.join(held, "target").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    targets = packed.select(F.col("cell").alias("target"), F.col("key.part").alias("part"), block_id.alias("target_block"), "ids", "vectors")
    seen = (
        visits.join(targets, ["target", "part"])
        .where(F.col("block") != F.col("target_block"))
        .select("query_ids", "queries", "ids", "vectors")
        .mapInPandas(_other_block(k + 1), lists)
    )
    entries = own.select("query", "scores", "ids").unionByName(seen)
    ranked = entries.select("query", F.inline(F.arrays_zip("scores", "ids"))).toDF("query", "score", "neighbour")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    top = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "score"))).alias("top"))

    # Back to all rows: members of a group share its list, each without itself.
    lists_by_unit = placed.select("query", "unit").join(top, "query").select("unit", "top")
    others = F.slice(F.filter("top", lambda e: e["neighbour"] != F.col(ID)), 1, k)
    return (
        keyed.join(lists_by_unit, "unit")
        .select(ID, F.posexplode(others).alias("pos", "e"))
        .select(ID, (F.col("pos") + 1).alias("rank"), "e.neighbour", F.col("e.score").alias("similarity"))
    )


def similar_for_all(df: DataFrame, k: int = 5, **options) -> DataFrame:
    """The ``k`` most similar places of every place, by standardised features."""
    rows = with_features(df)
    return nearest_for_all(rows.select(ID, F.array(*standardised(rows)).alias("vector")), k, **options)
