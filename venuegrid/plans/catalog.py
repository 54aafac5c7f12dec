"""All registered queries."""

from . import cluster_queries, duplicate_queries, recommend_queries, table_queries  # noqa: F401
from .registry import CATALOG

__all__ = ["CATALOG"]
