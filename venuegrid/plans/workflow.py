"""The batch run: raw rows to clean, deduplicated, clustered, named places."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean_places
from ..operators.clustering import DEFAULT_K, ClusterModel, fit_clusters, name_clusters
from ..operators.duplicates import THRESHOLD, remove_duplicates
from ..runtime import materialise
from ..sources.csv_source import read_places
from ..sources.tables import CLEANED, CLUSTERED, publish


@dataclass
class Result:
    cleaned: DataFrame
    clustered: DataFrame
    model: ClusterModel
    removal: DataFrame


def refine(raw: DataFrame, *, k: int | None = DEFAULT_K, threshold: float = THRESHOLD, headers=None, store=None, **fit) -> Result:
    """Run all stages on raw rows that carry an id. With ``store`` every stage is
    written there, so that a lost executor never costs more than one stage."""
    kept, removal = remove_duplicates(clean_places(raw, headers), threshold)
    cleaned = publish(kept, store, CLEANED) if store else materialise(kept)
    model, assigned = fit_clusters(cleaned, k, **fit)
    named = name_clusters(assigned, model.info.k)
    clustered = publish(named, store, CLUSTERED) if store else named
    return Result(cleaned, clustered, model, removal)


def run(spark: SparkSession, path: str, store: str, **options) -> Result:
    """Load a CSV and refine it, with all stages published below ``store``."""
    return refine(read_places(spark, path), store=store, **options)
