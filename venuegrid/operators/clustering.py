"""K-means on places: preparation, fit, choice of k, assignment, storage."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..runtime import materialise
from . import cluster_scores as scores
from .cleaning import apply_fences, drop_outliers, usable_for_clustering
from .features import FEATURES, TYPE_CODE, robust_scaled
from .kmeans import fit_runs, nearest_centre
from .profiles import cluster_names, cluster_quality, with_cluster_names

# Feature weights, fit settings and the least number of rows.
FEATURE_WEIGHTS = {"price": 0.5, "rating": 0.3, "distance": 0.15, TYPE_CODE: 0.05}
DEFAULT_K = 3
SEED = 42
MAX_ITERATIONS = 2_000
TOLERANCE = 1e-10
RESTARTS = 100
SEARCH_ITERATIONS = 500
SEARCH_RESTARTS = 20
SEARCH_TOLERANCE = 1e-4
LEAST_ROWS = 10
LARGEST_K = 8
COMPOSITE = {"silhouette": 0.5, "calinski_harabasz": 0.3, "davies_bouldin": 0.2}

SCALED = "scaled"


@dataclass
class FitInfo:
    """What is kept next to the fitted stages."""

    k: int
    rows: int
    fences: dict
    weights: dict
    weight_after_scaling: bool
    seed: int
    inertia: float
    centres: list
    metrics: dict = field(default_factory=dict)


@dataclass
class ClusterModel:
    """Fitted feature stages and centres. ``assign`` works row by row, so it
    accepts static and streaming tables alike."""

    stages: PipelineModel
    info: FitInfo

    def assign(self, df: DataFrame, outliers: str = "keep") -> DataFrame:
        """Add ``cluster``. Rows a fit would refuse are dropped; ``outliers``
        says whether rows outside the fitted fences are kept, dropped
        (``frozen``), or judged by fences of the new rows (``refit``)."""
        rows = df.na.drop("any")
        if outliers == "frozen":
            rows = apply_fences(rows, self.info.fences)
        elif outliers == "refit":
            rows, _ = drop_outliers(rows)
        elif outliers != "keep":
            raise ValueError(f"unknown outlier policy: {outliers}")
        return self.label(usable_for_clustering(rows)).drop("point")

    def label(self, rows: DataFrame) -> DataFrame:
        """Add the scaled features as ``point`` and the nearest centre as ``cluster``."""
        scaled = self.stages.transform(rows).withColumn("point", vector_to_array(SCALED))
        scaled = scaled.drop("features", "weighted", "unweighted", SCALED)
        return scaled.withColumn("cluster", nearest_centre(F.col("point"), self.info.centres))

    def feature_importance(self) -> DataFrame:
        """Share of each feature in the variance of the centres."""
        return centre_importance(self.info.centres)

    def save(self, path: str) -> None:
        """Write stages and fit information below ``path``."""
        self.stages.write().overwrite().save(f"{path}/stages")
        info = SparkSession.active().createDataFrame([(json.dumps(asdict(self.info)),)], "info string")
        info.coalesce(1).write.mode("overwrite").text(f"{path}/info")

    @classmethod
    def load(cls, path: str) -> "ClusterModel":
        """Read what ``save`` wrote; a missing path is an error."""
        text = "".join(r[0] for r in SparkSession.active().read.text(f"{path}/info").collect())
        return cls(PipelineModel.load(f"{path}/stages"), FitInfo(**json.loads(text)))


def centre_importance(centres: list[list[float]]) -> DataFrame:
    """Share of each feature in the variance of the centres; null if they agree."""
    rows = SparkSession.active().createDataFrame(list(enumerate(centres)), "cluster int, centre array<double>")
    spread = rows.select(F.posexplode("centre").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"))
    total = spread.agg(F.sum("v")).scalar()
    names = F.array(*[F.lit(c) for c in FEATURES])
    return spread.select(F.get(names, F.col("i")).alias("feature"), F.try_divide("v", total).alias("importance"))


def prepare(df: DataFrame) -> tuple[DataFrame, dict]:
    """Rows fit for clustering, and the outlier fences used on the way."""
    inside, fences = drop_outliers(df.na.drop("any"))
    return usable_for_clustering(inside), fences


def _type_indexer() -> StringIndexer:
    """Codes in sorted order of the types; a type not seen in the fit is an error."""
    return StringIndexer(inputCol="type", outputCol=TYPE_CODE, stringOrderType="alphabetAsc", handleInvalid="error")


def _feature_stages(weights: dict, after_scaling: bool) -> Pipeline:
    """Weights before scaling are divided out again by the scaler; placed after
    it they count."""
    index = _type_indexer()
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    product = Vectors.dense([float(weights.get(c, 1.0)) for c in FEATURES])
    scale = StandardScaler(withMean=True, withStd=True)
    if after_scaling:
        scale.setInputCol("features").setOutputCol("unweighted")
        weigh = ElementwiseProduct(scalingVec=product, inputCol="unweighted", outputCol=SCALED)
        return Pipeline(stages=[index, assemble, scale, weigh])
    weigh = ElementwiseProduct(scalingVec=product, inputCol="features", outputCol="weighted")
    scale.setInputCol("weighted").setOutputCol(SCALED)
    return Pipeline(stages=[index, assemble, weigh, scale])


def evaluate(assigned: DataFrame, vector: str, silhouette: str | None = "euclidean") -> dict[str, float]:
    """Scores of one clustering. ``silhouette`` may be exact but quadratic
    (``euclidean``), linear (``squared``), or left out (None)."""
    moments = scores.cluster_moments(assigned, vector)
    out = {
        "calinski_harabasz": scores.calinski_harabasz(assigned, vector, moments=moments).first()[0],
        "davies_bouldin": scores.davies_bouldin(assigned, vector, moments=moments).first()[0],
    }
    if silhouette == "euclidean":
        out["silhouette"] = scores.euclidean_silhouette(assigned, vector, ["cluster"]).first()["silhouette"]
    elif silhouette == "squared":
        out["silhouette"] = scores.squared_silhouette(assigned, vector)
    return out


def search_k(
    prepared: DataFrame,
    *,
    max_k: int = 10,
    seed: int = SEED,
    restarts: int = SEARCH_RESTARTS,
    max_iter: int = SEARCH_ITERATIONS,
    tol: float = SEARCH_TOLERANCE,
) -> DataFrame:
    """One row per k from 2 on, on robustly scaled features, with a composite
    of the three scores. Scaling divides weights out again, so they are not
    applied. All fits share their passes, and so do all silhouettes."""
    coded = prepared if TYPE_CODE in prepared.columns else _type_indexer().fit(prepared).transform(prepared)
    points = coded.select(F.array(*robust_scaled(coded)).alias("point")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = points.count()
        ks = list(range(2, min(max_k + 1, rows // 2)))
        if not ks:
            raise ValueError("too few rows to compare numbers of clusters")
        runs = fit_runs(points, ks, seed=seed, restarts=restarts, max_iter=max_iter, tol=tol)
        found = [{"k": k, "inertia": runs[k].cost} for k in ks]
        labels = {f"k{k}": nearest_centre(F.col("point"), runs[k].centres.tolist()) for k in ks}
        labelled = materialise(points.withColumns(labels))
        widths = {
            r["labeling"]: r["silhouette"]
            for r in scores.euclidean_silhouette(labelled, "point", [f"k{k}" for k in ks]).collect()
        }
        long = labelled.select(
            "point", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("cluster")) for k in ks]))
        )
        moments = scores.cluster_moments(long, "point", by=("k",))
        ch = scores.calinski_harabasz(long, "point", by=("k",), moments=moments)
        db = scores.davies_bouldin(long, "point", by=("k",), moments=moments)
        both = {r["k"]: r for r in ch.join(db, "k").collect()}
        for row in found:
            row["silhouette"] = widths[f"k{row['k']}"]
            row["calinski_harabasz"] = both[row["k"]]["calinski_harabasz"]
            row["davies_bouldin"] = both[row["k"]]["davies_bouldin"]
    finally:
        points.unpersist()
    top_ch = max(r["calinski_harabasz"] for r in found)
    top_db = max(r["davies_bouldin"] for r in found)
    for r in found:
        r["composite"] = (
            COMPOSITE["silhouette"] * r["silhouette"]
            + COMPOSITE["calinski_harabasz"] * r["calinski_harabasz"] / top_ch
            + COMPOSITE["davies_bouldin"] * (1 - r["davies_bouldin"] / top_db)
        )
    columns = ["k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin", "composite"]
    schema = "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, composite double"
    return prepared.sparkSession.createDataFrame([tuple(r[c] for c in columns) for r in found], schema)


def best_k(search: DataFrame) -> int:
    """The k with the highest composite, the smallest on ties."""
    return search.orderBy(F.desc("composite"), "k").first()["k"]


def fit_clusters(
    df: DataFrame,
    k: int | None = DEFAULT_K,
    *,
    seed: int = SEED,
    restarts: int = RESTARTS,
    max_iter: int = MAX_ITERATIONS,
    tol: float = TOLERANCE,
    weights: dict | None = None,
    weight_after_scaling: bool = False,
    silhouette: str | None = "euclidean",
) -> tuple[ClusterModel, DataFrame]:
    """Fit on the rows that pass preparation; ``k=None`` searches for k.

    Returns the model and the rows it was fitted on with their cluster.
    """
    weights = {**FEATURE_WEIGHTS, **(weights or {})}
    rows, fences = prepare(df)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if n < LEAST_ROWS:
            raise ValueError(f"clustering needs at least {LEAST_ROWS} rows, got {n}")
        if k is None:
            k = best_k(search_k(rows, max_k=min(LARGEST_K, n // 3), seed=seed))
        stages = _feature_stages(weights, weight_after_scaling).fit(rows)
        points = stages.transform(rows).select(vector_to_array(SCALED).alias("point"))
        best = fit_runs(points, [k], seed=seed, restarts=restarts, max_iter=max_iter, tol=tol)[k]
        info = FitInfo(
            k=k,
            rows=n,
            fences={c: list(f) for c, f in fences.items()},
            weights=weights,
            weight_after_scaling=weight_after_scaling,
            seed=seed,
            # The scaler uses the sample deviation; report the population one.
            inertia=best.cost * n / (n - 1),
            centres=best.centres.tolist(),
        )
        model = ClusterModel(stages, info)
        assigned = materialise(model.label(rows).select(*df.columns, TYPE_CODE, "cluster", "point"))
    finally:
        rows.unpersist()
    metrics = evaluate(assigned, "point", silhouette)
    metrics.update(cluster_quality(assigned, k).first().asDict())
    model.info.metrics = metrics
    return model, assigned.drop("point")


def from_centres(
    rows: DataFrame, centres: list[list[float]], *, fences: dict | None = None, weights: dict | None = None, weight_after_scaling: bool = False
) -> ClusterModel:
    """A model with known centres, in the features as scaled over the prepared ``rows``."""
    weights = {**FEATURE_WEIGHTS, **(weights or {})}
    stages = _feature_stages(weights, weight_after_scaling).fit(rows)
    points = stages.transform(rows).select(vector_to_array(SCALED).alias("point"))
    gaps = [sum(((F.get("point", F.lit(d)) - F.lit(float(x))) ** 2 for d, x in enumerate(c)), F.lit(0.0)) for c in centres]
    n, cost = points.agg(F.count("*"), F.sum(F.least(*gaps) if len(gaps) > 1 else gaps[0])).first()
    fences = {c: list(f) for c, f in (fences or {}).items()}
    return ClusterModel(stages, FitInfo(len(centres), n, fences, weights, weight_after_scaling, SEED, cost * n / max(1, n - 1), [list(map(float, c)) for c in centres]))


def name_clusters(assigned: DataFrame, k: int | None = None) -> DataFrame:
    """Add the price-ordered name of every row's cluster."""
    return with_cluster_names(assigned, cluster_names(assigned, k))
