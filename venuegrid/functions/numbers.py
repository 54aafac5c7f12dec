"""Numeric expressions: coercion, safe arithmetic and banding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, _col

NUMERIC = (
    rf"^[{SPACE}]*[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))[{SPACE}]*$"
)

# Upper limits of price and distance bands, lower limits of the others.
PRICE_BANDS = ((25000, "Budget"), (50000, "Moderate"), (100000, "Expensive"))
DISTANCE_BANDS = ((1, "Very Close"), (3, "Close"), (5, "Moderate"), (10, "Far"))
RATING_BANDS = ((4.5, "Excellent"), (4.0, "Very Good"), (3.5, "Good"), (3.0, "Average"), (2.0, "Below Average"))
QUALITY_BANDS = ((90, "Sangat Baik"), (70, "Baik"), (50, "Cukup"))
SILHOUETTE_BANDS = ((0.5, "Good"), (0.3, "Fair"))


def known(c) -> Column:
    """The value with NaN turned into null, so one test covers both."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def to_number(c) -> Column:
    """Number held in a text, or null; suffixed literals such as ``1d`` are text."""
    text = _col(c).cast("string")
    return F.when(F.regexp_like(text, F.lit(NUMERIC)), known(F.trim(text).try_cast("double")))


def safe_divide(n, d, default: float = 0.0) -> Column:
    """Quotient, or ``default`` where the divisor is zero or anything is null."""
    return F.coalesce(F.try_divide(_col(n).cast("double"), _col(d).cast("double")), F.lit(float(default)))


def normalise(c, low, high) -> Column:
    """Position of a value between two bounds, clamped to [0, 1]."""
    v, lo, hi = (known(x) for x in (c, low, high))
    position = F.try_divide(v - lo, hi - lo)
    return (
        F.when(v.isNull() | lo.isNull() | hi.isNull(), F.lit(0.0))
        .when(hi == lo, F.lit(0.5))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), position)))
    )


def _band(c, steps, last: str, test) -> Column:
    v = known(c)
    out = F.when(v.isNull(), F.lit("Unknown"))
    for limit, label in steps:
        out = out.when(test(v, F.lit(float(limit))), F.lit(label))
    return out.otherwise(F.lit(last))


def _at_most(v, x):
    return v <= x


def _at_least(v, x):
    return v >= x


def price_band(c) -> Column:
    return _band(c, PRICE_BANDS, "Premium", _at_most)


def distance_band(c) -> Column:
    return _band(c, DISTANCE_BANDS, "Very Far", _at_most)


def rating_band(c) -> Column:
    return _band(c, RATING_BANDS, "Poor", _at_least)


def quality_band(c) -> Column:
    return _band(c, QUALITY_BANDS, "Perlu Perbaikan", _at_least)


def silhouette_band(c) -> Column:
    return _band(c, SILHOUETTE_BANDS, "Poor", lambda v, x: v > x)
