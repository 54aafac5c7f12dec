"""From raw source rows to clean place rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_number
from ..functions.text import canonical_type, strip
from ..schema import MEASURES, PLACE_COLUMNS, SOURCE_HEADERS
from .quantiles import exact_quantiles


def rename_headers(df: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(headers or SOURCE_HEADERS)


def rename_by_position(df: DataFrame) -> DataFrame:
    """Names by position for six or seven columns, ``col_i`` otherwise."""
    width = len(df.columns)
    if width in (6, 7):
        return df.toDF(*(PLACE_COLUMNS + ("extra",))[:width])
    return df.toDF(*[f"col_{i}" for i in range(width)])


def coerce_numbers(df: DataFrame, columns=MEASURES) -> DataFrame:
    """Texts become numbers; what is no number becomes null."""
    return df.withColumns({c: to_number(c) for c in columns})


def in_valid_range(df: DataFrame) -> DataFrame:
    return df.where((F.col("price") > 0) & F.col("rating").between(1, 5) & (F.col("distance") >= 0))


def clean_places(df: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Rename, coerce, drop unusable rows and tidy texts. Narrow throughout,
    so it runs inside the scan stage. Duplicates are handled separately."""
    named = coerce_numbers(rename_headers(df, headers))
    usable = in_valid_range(named.na.drop(subset=["name", *MEASURES]))
    return usable.withColumns({"name": strip("name"), "type": canonical_type("type")})


def iqr_bounds(df: DataFrame, column: str, width: float = 1.5) -> tuple[float, float] | None:
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    return None if q1 is None else (q1 - width * (q3 - q1), q3 + width * (q3 - q1))


def drop_outliers(df: DataFrame, columns=("price", "distance")) -> tuple[DataFrame, dict]:
    """Keep values inside the interquartile fences, one column after another:
    later fences are computed on what earlier ones left. The fences end up as
    literals, so the scan can use them, and are returned for later reuse."""
    fences = {}
    for c in columns:
        fence = iqr_bounds(df, c)
        if fence is not None:
            fences[c] = fence
            df = df.where(F.col(c).between(*fence))
    return df, fences


def apply_fences(df: DataFrame, fences: dict) -> DataFrame:
    for c, (low, high) in fences.items():
        df = df.where(F.col(c).between(low, high))
    return df


def usable_for_clustering(df: DataFrame) -> DataFrame:
    """Stricter than cleaning: a distance of zero is not accepted here."""
    return df.where(F.col("rating").between(1, 5) & (F.col("price") > 0) & (F.col("distance") > 0))
