"""Stage tables of the batch run, and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import filter_places

CLEANED, CLUSTERED = "places_clean", "places_clustered"
STAGES = (CLUSTERED, CLEANED)
EMPTY = "place_id long, name string, type string, price double, rating double, location string, distance double"


def publish(df: DataFrame, store: str, stage: str) -> DataFrame:
    """Write a stage and return it read back, which also cuts its lineage.
    Clustered places are laid out by cluster, so cluster queries prune files."""
    writer = df.write.mode("overwrite")
    if stage == CLUSTERED:
        writer = writer.partitionBy("cluster")
    writer.parquet(f"{store}/{stage}")
    return df.sparkSession.read.parquet(f"{store}/{stage}")


def read_published(spark: SparkSession, store: str, filters: dict | None = None) -> DataFrame:
    """The latest stage there is, else an empty table; optionally filtered."""
    for stage in STAGES:
        try:
            table = spark.read.parquet(f"{store}/{stage}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return filter_places(table, **filters) if filters else table
    return spark.createDataFrame([], EMPTY)


def export(df: DataFrame, path: str, format: str = "csv") -> None:
    """Write as CSV with header, or as one JSON record per line."""
    kind = format.lower()
    if kind == "csv":
        writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif kind == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unsupported format: {format}")
