"""Text shown for prices, distances and ratings. Halves round to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import known


def _fixed(c: Column, digits: int) -> Column:
    # A decimal keeps trailing zeros and needs no second, half-up rounding.
    return F.bround(c, digits).cast(f"decimal(30,{digits})").cast("string")


def format_currency(c, currency: str = "IDR") -> Column:
    v = known(c)
    if currency != "IDR":
        text = F.concat(F.lit(f"{currency} "), F.format_number(F.bround(v, 2), 2))
        return F.when(v.isNull(), F.lit("N/A")).otherwise(text)
    return (
        F.when(v.isNull(), F.lit("N/A"))
        .when(v >= 1_000_000, F.concat(F.lit("Rp "), _fixed(v / F.lit(1e6), 1), F.lit("M")))
        .when(v >= 1_000, F.concat(F.lit("Rp "), _fixed(v / F.lit(1e3), 0), F.lit("K")))
        .otherwise(F.concat(F.lit("Rp "), F.format_number(F.bround(v, 0), 0)))
    )


def format_distance(c, unit: str = "km") -> Column:
    v = known(c)
    text = F.concat(_fixed(v, 1), F.lit(f" {unit}"))
    if unit == "km":
        text = F.when(v < 1, F.concat(_fixed(v * 1000, 0), F.lit(" m"))).otherwise(text)
    return F.when(v.isNull(), F.lit("N/A")).otherwise(text)


def format_rating(c, max_rating: int = 5) -> Column:
    v = F.greatest(F.lit(0.0), F.least(known(c), F.lit(float(max_rating))))
    full = F.floor(v).cast("int")
    stars = F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), F.lit(max_rating) - full))
    return F.when(known(c).isNull(), F.lit("N/A")).otherwise(F.concat(_fixed(v, 1), F.lit("/5 "), stars))
