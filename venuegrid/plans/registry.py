"""Named queries over the given tables, each with its check SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    check: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, *views: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``views`` are the views its check SQL reads."""

    def register(run: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(run, with_views(check, *views) if check and views else check)
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums differ in their last digits between engines; compare the others."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})
