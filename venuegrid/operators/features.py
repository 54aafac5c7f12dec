"""Numeric features of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise
from .quantiles import exact_quantiles

TYPE_CODE = "type_encoded"
FEW_TYPES = 200
FEATURES = ("price", "rating", "distance", TYPE_CODE)


def with_type_code(df: DataFrame) -> DataFrame:
    """Code of the type: its place among the sorted distinct types. A few types
    become a literal list; many are numbered by ranges and looked up by a join."""
    types = materialise(df.select("type").where(F.col("type").isNotNull()).distinct())
    if types.count() <= FEW_TYPES:
        found = [r["type"] for r in types.orderBy("type").collect()]
        position = F.array_position(F.array(*[F.lit(t) for t in found]).cast("array<string>"), F.col("type"))
        return df.withColumn(TYPE_CODE, (position - 1).cast("double"))
    codes = broadcast_if_small(_numbered(types).withColumnRenamed("place", TYPE_CODE))
    return df.join(codes, "type", "left").select(*df.columns, TYPE_CODE)


def _numbered(types: DataFrame) -> DataFrame:
    """Each type's place in their order: the types of all ranges before its own, which are
    counted first, and its place among those of its range."""
    ranges = materialise(types.repartitionByRange("type").withColumn("range", F.spark_partition_id()))
    before, found = [], 0
    for r in ranges.groupBy("range").agg(F.count("*").alias("types")).orderBy("range").collect():
        before += [F.lit(r["range"]), F.lit(found)]
        found += r["types"]
    own = F.row_number().over(Window.partitionBy("range").orderBy("type")) - 1
    return ranges.select("type", (F.element_at(F.create_map(*before), F.col("range")) + own).cast("double").alias("place"))


def with_features(df: DataFrame) -> DataFrame:
    """Make sure every feature column exists."""
    return df if TYPE_CODE in df.columns else with_type_code(df)


def standardised(df: DataFrame, columns=FEATURES) -> list[Column]:
    """(x - mean) / population deviation; a constant column becomes zero. One
    pass for all columns; its few numbers become literals."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]).first()
    return [
        (F.col(c).cast("double") - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"]) if stats[c]["std"] else F.lit(0.0)
        for c in columns
    ]


def robust_scaled(df: DataFrame, columns=FEATURES) -> list[Column]:
    """(x - median) / interquartile range, exact; without spread only centred."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return [(F.col(c).cast("double") - F.lit(q[c][1])) / F.lit((q[c][2] - q[c][0]) or 1.0) for c in columns]
