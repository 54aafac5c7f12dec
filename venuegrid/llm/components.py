"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, name: str = "components", scratch: Scratch | None = None) -> DataFrame:
    """(node, component): the smallest node that ``edges`` (a, b; long) reach from each
    node that they name, itself included.

    Alternating large-star and small-star steps: each node hands its neighbours to its
    smallest one, until the graph is a set of stars. Rounds grow with the logarithm of a
    chain's length. Every step is a minimum by node, which is written, and a join with it; a
    node with very many neighbours has one row on the right side, so its rows can be split.
    Nothing is gathered, on the driver or elsewhere. Only the last round's edges stay.
    """
    scratch = scratch or Scratch(edges.sparkSession, name)
    edges = scratch.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.written(large, name)
        scratch.drop(edges, least)
        least = scratch.written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = scratch.written(small.where("a <> b").distinct(), name)
        scratch.drop(large, least)
        now = _digest(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit((1 << 40) - 1)))).first())
