"""Scores of a clustering, for points held as an array column.

Calinski-Harabasz, Davies-Bouldin and inertia need one or two passes. The exact
mean Euclidean silhouette needs every distance: see ``euclidean_silhouette``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise

BLOCK_POINTS = 8_192
#: Distances that a task holds at a time.
MATRIX_CELLS = 1 << 22
#: Squared distances below this share of the squared lengths are summed up singly, so many at a time.
CANCELLED = 1e-7
NEAR_PAIRS = 1 << 16


def dimensions(df: DataFrame, vector: str) -> int:
    row = df.select(F.size(vector)).first()
    return row[0] if row else 0


def cluster_moments(df: DataFrame, vector: str, cluster: str = "cluster", by: tuple[str, ...] = ()) -> DataFrame:
    """One row per cluster and dimension: size, mean and population variance.
    ``by`` names columns that tell several clusterings apart. The few rows are
    materialised, since every score starts from them."""
    d = dimensions(df, vector)
    x = [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(d)]
    moments = [F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(f"d{i}") for i, c in enumerate(x)]
    wide = df.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), *moments)
    long = wide.select(*by, "cluster", "n", F.posexplode(F.array(*[F.col(f"d{i}") for i in range(d)])).alias("dim", "m"))
    return materialise(long.select(*by, "cluster", "n", "dim", "m.mean", "m.var"))


def inertia(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """One row: sum of squared distances to the cluster means."""
    moments = cluster_moments(df, vector, cluster)
    return moments.agg(F.coalesce(F.sum(F.col("n") * F.col("var")), F.lit(0.0)).alias("inertia"))


def calinski_harabasz(
    df: DataFrame, vector: str, cluster: str = "cluster", by: tuple[str, ...] = (), moments: DataFrame | None = None
) -> DataFrame:
    """Between-cluster against within-cluster dispersion, one row per clustering."""
    per_dim = Window.partitionBy(*by, "dim")
    centred = (cluster_moments(df, vector, cluster, by) if moments is None else moments).withColumn(
        "grand", F.sum(F.col("n") * F.col("mean")).over(per_dim) / F.sum("n").over(per_dim)
    )
    shift = F.col("mean") - F.col("grand")
    sums = centred.groupBy(*by).agg(
        F.sum(F.col("n") * shift * shift).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("total"),
        F.count_if(F.col("dim") == 0).alias("clusters"),
    )
    freedom = F.col("total") - F.col("clusters")
    ratio = F.try_divide(F.col("between") / (F.col("clusters") - 1), F.col("within") / freedom)
    return sums.select(*by, F.when(F.col("within") == 0, F.lit(1.0)).otherwise(ratio).alias("calinski_harabasz"))


def _distance(a: Column, b: Column, d: int) -> Column:
    terms = [F.get(a, F.lit(i)).cast("double") - F.get(b, F.lit(i)) for i in range(d)]
    return F.sqrt(sum((t * t for t in terms), F.lit(0.0)))


def davies_bouldin(
    df: DataFrame, vector: str, cluster: str = "cluster", by: tuple[str, ...] = (), moments: DataFrame | None = None
) -> DataFrame:
    """Mean over clusters of the worst ratio of spread to separation, one row
    per clustering."""
    moments = cluster_moments(df, vector, cluster, by) if moments is None else moments
    d = moments.agg(F.max("dim")).first()[0]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda e: e["mean"])
    centres = broadcast_if_small(moments.groupBy(*by, "cluster").agg(ordered.alias("centre")))
    points = df.select(*by, F.col(cluster).alias("cluster"), F.col(vector).alias("point"))
    gap = _distance(F.col("point"), F.col("centre"), (d or 0) + 1)
    spread = points.join(centres, [*by, "cluster"]).groupBy(*by, "cluster").agg(F.avg(gap).alias("spread"))
    # k clusters: every one meets the others on each coordinate.
    long = materialise(moments.select(*by, "cluster", "dim", "mean").join(spread, [*by, "cluster"]))
    a, b = long.alias("a"), long.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "dim")]
    away = F.col("a.mean") - F.col("b.mean")
    names = [F.col(f"a.{c}").alias(c) for c in by]
    pairs = (
        a.join(b, [*same, F.col("a.cluster") != F.col("b.cluster")])
        .groupBy(*names, F.col("a.cluster").alias("i"), F.col("b.cluster").alias("j"))
        .agg(F.max(F.col("a.spread") + F.col("b.spread")).alias("spreads"), F.sqrt(F.sum(away * away)).alias("apart"))
    )
    ratio = F.coalesce(F.try_divide(F.col("spreads"), F.col("apart")), F.lit(0.0))
    worst = pairs.groupBy(*by, "i").agg(F.max(ratio).alias("worst"))
    return worst.groupBy(*by).agg(F.coalesce(F.avg("worst"), F.lit(0.0)).alias("davies_bouldin"))


def _pack_block(labelings: int):
    """The points of a block as one row of arrays."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["point"].tolist(), "<f8").reshape(len(rows), -1)
        labels = np.array(rows["labels"].tolist(), "<i4").reshape(len(rows), labelings)
        arrays = (x, labels, rows["weight"].to_numpy("<f8"))
        return pd.DataFrame([[rows["block"].iloc[0], *(np.ascontiguousarray(v).tobytes() for v in arrays)]], columns=["block", "x", "labels", "weight"])

    return run


def _unpacked(labelings: int):
    """Labels and weight of every point of the packed blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, packed, weight in batch.itertuples(index=False):
                labels = np.frombuffer(packed, "<i4").reshape(-1, labelings)
                yield pd.DataFrame({"block": block, "pos": np.arange(len(labels)), "labels": list(labels), "weight": np.frombuffer(weight, "<f8")})

    return run


def _members(labels: bytes, weight: bytes, width: int, offsets: list[int]) -> np.ndarray:
    """Weight of each point in each cluster of all labelings."""
    w = np.frombuffer(weight, "<f8")
    codes = np.frombuffer(labels, "<i4").reshape(len(w), len(offsets))
    member = np.zeros((len(w), width))
    for column in (codes + np.array(offsets)).T:
        member[np.arange(len(w)), column] = w
    return member


def _distances(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances, by one matrix product; those it would cancel out are taken singly."""
    apart = y @ x.T
    apart *= -2.0
    lengths_y, lengths_x = (y**2).sum(axis=1), (x**2).sum(axis=1)
    apart += lengths_y[:, None]
    apart += lengths_x[None, :]
    near = np.flatnonzero(apart.ravel() < CANCELLED * (lengths_y.max() + lengths_x.max()))
    for at in range(0, len(near), NEAR_PAIRS):
        some = near[at : at + NEAR_PAIRS]
        i, j = np.divmod(some, len(x))
        apart.ravel()[some] = ((y[i] - x[j]) ** 2).sum(axis=1)
    return np.sqrt(apart, out=apart)


def _distance_sums(width: int, offsets: list[int]):
    """Per point of both blocks, the weighted distances to each cluster of the other one; of
    a block with itself once."""

    def rows_of(block: int, sums: np.ndarray) -> pd.DataFrame:
        found = pd.DataFrame(sums, columns=[f"s{i}" for i in range(width)])
        found.insert(0, "pos", np.arange(len(sums)))
        found.insert(0, "block", block)
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                member_x, member_y = (_members(*side, width, offsets) for side in ((row.labels, row.weight), (row.target_labels, row.target_weight)))
                x = np.frombuffer(row.x, "<f8").reshape(len(member_x), -1)
                y = np.frombuffer(row.target_x, "<f8").reshape(len(member_y), -1)
                # Near the origin less is cancelled out.
                middle = y.mean(axis=0)
                x, y = x - middle, y - middle
                itself = row.block == row.target
                left, right = np.zeros_like(member_y), np.zeros_like(member_x)
                step = max(1, MATRIX_CELLS // len(x))
                for at in range(0, len(y), step):
                    apart = _distances(y[at : at + step], x)
                    left[at : at + step] = apart @ member_x
                    if not itself:
                        right += apart.T @ member_y[at : at + step]
                yield rows_of(row.target, left)
                if not itself:
                    yield rows_of(row.block, right)

    return run


def euclidean_silhouette(df: DataFrame, vector: str, labelings: list[str], block_points: int = BLOCK_POINTS) -> DataFrame:
    """Exact mean Euclidean silhouette, one row per labeling column.

    Equal points are merged first and carry a weight. The rest is cut into
    blocks by hash; each task holds two blocks, multiplies a distance matrix
    with the cluster memberships of all labelings at once, and returns sums per
    point of both. No pair of points is ever shuffled, but the number of distances is
    quadratic; ``squared_silhouette`` is the linear alternative.
    """
    points = materialise(
        df.groupBy(F.col(vector).cast("array<double>").alias("point"), *labelings).agg(F.count("*").alias("weight"))
    )
    sizes: dict[str, dict[int, int]] = {}
    for column in labelings:
        counts = points.groupBy(column).agg(F.sum("weight").alias("n")).orderBy(column).collect()
        sizes[column] = {r[column]: r["n"] for r in counts}
    codes = {c: {label: i for i, label in enumerate(sizes[c])} for c in labelings}
    offsets = list(np.cumsum([0] + [len(sizes[c]) for c in labelings])[:-1].tolist())
    width = sum(len(s) for s in sizes.values())

    blocks = max(1, -(-points.count() // block_points))
    coded = points.select(
        "point", "weight",
        F.array(*[_lookup(c, codes[c]) for c in labelings]).alias("labels"),
        F.pmod(F.xxhash64("point", *labelings), F.lit(blocks)).cast("int").alias("block"),
    )
    packed = materialise(
        coded.repartition(blocks, "block").groupBy("block").applyInPandas(
            _pack_block(len(labelings)), "block int, x binary, labels binary, weight binary"
        )
    )
    # Every two blocks meet once: a block with itself and the next half of a circle of all.
    half, even = blocks // 2, blocks % 2 == 0
    targets = F.transform(F.sequence(F.lit(0), F.lit(half)), lambda s: F.pmod(F.col("block") + s, F.lit(blocks)))
    if even:
        # Opposite blocks see each other from both sides.
        targets = F.filter(targets, lambda t: (F.abs(t - F.col("block")) != half) | (F.col("block") < t))
    shares = max(1, -(-3 * df.sparkSession.sparkContext.defaultParallelism // blocks))
    share = F.pmod(F.col("block"), F.lit(shares)).alias("share")
    sources = packed.select("*", F.explode(targets).alias("target"), share)
    other = packed.select(
        F.col("block").alias("target"), F.col("x").alias("target_x"), F.col("labels").alias("target_labels"),
        F.col("weight").alias("target_weight"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
    )
    keys = ("target", "share")
    partial = (
        sources.repartition(blocks * shares, *keys)
        .join(other.repartition(blocks * shares, *keys), list(keys))
        .mapInPandas(_distance_sums(width, offsets), ", ".join(["block int", "pos int", *(f"s{i} double" for i in range(width))]))
    )
    sums = partial.groupBy("block", "pos").agg(F.array(*[F.sum(f"s{i}") for i in range(width)]).alias("sums"))
    members = packed.select("block", "labels", "weight").mapInPandas(
        _unpacked(len(labelings)), "block int, pos int, labels array<int>, weight double"
    )
    per_point = members.join(sums, ["block", "pos"])
    rows = []
    for i, column in enumerate(labelings):
        rows.append(
            F.struct(
                F.lit(column).alias("labeling"),
                (F.sum(_width(i, offsets[i], list(sizes[column].values())) * F.col("weight")) / F.sum("weight")).alias(
                    "silhouette"
                ),
            )
        )
    return per_point.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _lookup(column: str, codes: dict) -> Column:
    pairs = [x for label, i in codes.items() for x in (F.lit(label), F.lit(i))]
    return F.element_at(F.create_map(*pairs), F.col(column))


def _width(labeling: int, offset: int, sizes: list[int]) -> Column:
    """Silhouette of one point from its distance sums."""
    own = F.get("labels", F.lit(labeling))
    own_size = F.get(F.array(*[F.lit(float(n)) for n in sizes]), own)
    own_sum = F.get(F.col("sums"), own + offset)
    inside = F.try_divide(own_sum, own_size - 1)
    others = [
        F.when(own != c, F.get("sums", F.lit(offset + c)) / float(n)) for c, n in enumerate(sizes)
    ]
    outside = F.array_min(F.array(*others))
    value = F.coalesce(F.try_divide(outside - inside, F.greatest(inside, outside)), F.lit(0.0))
    return F.when(own_size <= 1, F.lit(0.0)).otherwise(value)


def squared_silhouette(df: DataFrame, vector: str, cluster: str = "cluster") -> float:
    """Mean silhouette under squared Euclidean distance, in linear time."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    points = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"), F.col(cluster).cast("double").alias("c"))
    return ClusteringEvaluator(featuresCol="v", predictionCol="c").evaluate(points)
