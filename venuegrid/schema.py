"""Column roles, source headers and label sets shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = "place_id"
MEASURES = ("price", "rating", "distance")
PLACE_COLUMNS = ("name", "type", "price", "rating", "location", "distance")

# The headers of the source file and the column each one becomes.
SOURCE_HEADERS = {
    "Nama Tempat": "name",
    "Tipe Tempat": "type",
    "Estimasi Harga (RP.)": "price",
    "Rating Tempat Makan": "rating",
    "Lokasi (maps)": "location",
    "Jarak dari kampus (km)": "distance",
}

# Cluster labels from the cheapest to the dearest cluster.
CLUSTER_LABELS = {
    2: ("Ekonomis", "Premium"),
    3: ("Ekonomis", "Menengah", "Premium"),
    4: ("Ekonomis", "Menengah", "Tinggi", "Premium"),
    5: ("Ekonomis", "Menengah", "Tinggi", "Mewah", "Premium"),
}


def cluster_labels(k: int) -> list[str]:
    """Labels for ``k`` clusters in price order."""
    return list(CLUSTER_LABELS.get(k) or [f"Kategori {i + 1}" for i in range(k)])


def missing_columns(df: DataFrame, required=tuple(SOURCE_HEADERS)) -> list[str]:
    """Required columns that ``df`` lacks, in the order required."""
    return [c for c in required if c not in df.columns]


def result_rows(df: DataFrame, *extra: str) -> DataFrame:
    """The row shape every recommendation query returns."""
    cluster = F.col("cluster").cast("int") if "cluster" in df.columns else F.lit(None).cast("int")
    return df.select(
        ID,
        "name",
        "type",
        # Infinite and very large prices have no whole number; they are shown as null.
        F.col("price").try_cast("long").alias("price"),
        F.col("rating").cast("double").alias("rating"),
        F.col("distance").cast("double").alias("distance"),
        "location",
        cluster.alias("cluster"),
        *extra,
    )
