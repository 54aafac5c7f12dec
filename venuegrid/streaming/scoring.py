"""Assigning clusters to a stream of places.

A fitted model works row by row, so the batch expressions serve unchanged; there
is no state, hence no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clustering import ClusterModel


def assign_stream(model: ClusterModel, stream: DataFrame, names: dict[int, str] | None = None, outliers: str = "keep") -> DataFrame:
    """The stream with cluster and, if ``names`` are given, cluster name."""
    if outliers == "refit":
        raise ValueError("a stream has no fences of its own")
    assigned = model.assign(stream, outliers)
    if not names:
        return assigned
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    fallback = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    return assigned.withColumn("cluster_name", F.coalesce(F.element_at(pairs, F.col("cluster")), fallback))


def write_stream(assigned: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet files, then stop; run again for more."""
    return (
        assigned.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
