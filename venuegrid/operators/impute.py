"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import known
from .quantiles import exact_quantiles


def _modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent text of each column, the smallest on ties. Counts are
    shuffled per value, so no buffer holds all values of a column."""
    if not columns:
        return {}
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    ).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("minus"), "value"))["value"].alias("mode"))
    found = {r["column"]: r["mode"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def handle_missing(df: DataFrame, strategy: str = "drop") -> DataFrame:
    """``drop`` rows with nulls, or fill: ``fill_mean`` fills numbers with the
    mean and texts with the mode, ``fill_median`` fills numbers only. Any other
    strategy leaves the table as it is."""
    if strategy == "drop":
        return df.na.drop("any")
    if strategy not in ("fill_mean", "fill_median"):
        return df
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    gaps = df.agg(F.lit(0), *[F.count_if(known(c).isNull()).alias(c) for c in numbers]).first()
    numbers = [c for c in numbers if gaps[c]]
    fills: dict = {}
    if strategy == "fill_mean":
        if numbers:
            fills.update(df.agg(*[F.avg(known(c)).alias(c) for c in numbers]).first().asDict())
        fills.update({c: "Unknown" if m is None else m for c, m in _modes(df, texts).items()})
    elif numbers:
        fills.update({c: q[0] for c, q in exact_quantiles(df, numbers, [0.5]).items()})
    # The fill of an integer column need not be an integer, so it becomes double.
    out = {
        c: F.coalesce(known(c) if c in numbers else F.col(c), F.lit(v)) for c, v in fills.items() if v is not None
    }
    return df.withColumns(out) if out else df
