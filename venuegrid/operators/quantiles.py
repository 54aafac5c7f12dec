"""Exact, linearly interpolated quantiles for tables of any size.

Spark's ``percentile`` keeps every distinct value in one aggregation buffer.
That is fine for a bounded number of rows. Beyond it, a mergeable sketch
brackets each quantile, one more pass counts what lies below the bracket, and
only the few rows inside it are ranked exactly. The counts prove the bracket,
so the sketch's error affects cost, never the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import known

DIRECT_ROWS = 1_000_000
SKETCH_ACCURACY = 100_000
CUTS = 200


def exact_quantiles(
    df: DataFrame,
    columns: list[str] | tuple[str, ...],
    probabilities: list[float] | tuple[float, ...],
    direct_rows: int = DIRECT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles of each column, nulls and NaN skipped; None for an empty column."""
    values = df.select(*[known(c).alias(c) for c in columns])
    counts = values.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    small = [c for c in columns if 0 < counts[c] <= direct_rows]
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if small:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        out.update(values.agg(*[F.percentile(c, probs).alias(c) for c in small]).first().asDict())
    large = {c: counts[c] for c in columns if counts[c] > direct_rows}
    if large:
        out.update(_bracketed(values, large, probabilities, direct_rows, accuracy))
    return out


@dataclass
class _Target:
    """One quantile: the ranks it lies between, and the bracket around them."""

    column: str
    rows: int
    probability: float
    low: float = 0.0
    high: float = 0.0
    before: int = 0
    held: int = 0
    distinct: int = 0
    found: tuple[float, float] | None = None

    @property
    def position(self) -> float:
        return self.probability * (self.rows - 1)

    @property
    def ranks(self) -> tuple[int, int]:
        first = math.floor(self.position)
        return first, min(first + 1, self.rows - 1)

    def ends(self, accuracy: int) -> list[float]:
        i, j = self.ranks
        slack = 2.0 / accuracy
        return [max(0.0, i / self.rows - slack), min(1.0, (j + 1) / self.rows + slack)]

    @property
    def proven(self) -> bool:
        i, j = self.ranks
        return self.before <= i and j < self.before + self.held

    @property
    def value(self) -> float:
        first, second = self.found
        return first if first == second else first + (second - first) * (self.position - math.floor(self.position))


def _bracketed(values: DataFrame, rows: dict[str, int], probabilities, direct_rows: int, accuracy: int) -> dict:
    """All quantiles of all columns in three passes: sketch, count, rank."""
    targets = [_Target(c, n, p) for c, n in rows.items() for p in probabilities]
    ends = {c: [e for t in targets if t.column == c for e in t.ends(accuracy)] for c in rows}
    sketch = values.agg(
        *[F.percentile_approx(c, F.array(*[F.lit(e) for e in es]), F.lit(accuracy)).alias(c) for c, es in ends.items()]
    ).first()
    for c in rows:
        for k, t in enumerate(t for t in targets if t.column == c):
            t.low, t.high = sketch[c][2 * k], sketch[c][2 * k + 1]
    counts = []
    for k, t in enumerate(targets):
        inside = F.col(t.column).between(t.low, t.high)
        counts += [
            F.count_if(F.col(t.column) < t.low).alias(f"before{k}"),
            F.count_if(inside).alias(f"held{k}"),
            F.approx_count_distinct(F.when(inside, F.col(t.column))).alias(f"distinct{k}"),
        ]
    counted = values.agg(*counts).first()
    for k, t in enumerate(targets):
        t.before, t.held, t.distinct = (counted[f"{name}{k}"] for name in ("before", "held", "distinct"))
        if t.proven and t.low == t.high:
            t.found = (t.low, t.high)
    ready = {k: t for k, t in enumerate(targets) if t.found is None and t.proven and t.distinct <= direct_rows // 2}
    if ready:
        _rank(values, ready)
    for t in targets:
        if t.found is None:  # a wide bracket: narrow it step by step
            column = values.select(F.col(t.column).alias("v")).where(F.col("v").isNotNull())
            t.found = _order_statistics(column, t.rows, *t.ranks, direct_rows, accuracy)
    return {c: [t.value for t in targets if t.column == c] for c in rows}


def _rank(values: DataFrame, targets: dict[int, _Target]) -> None:
    """Look the ranks up among the values inside each bracket."""
    inside = [
        F.struct(
            F.lit(k).alias("target"),
            F.when(F.col(t.column).between(t.low, t.high), F.col(t.column)).alias("v"),
            *[F.lit(r - t.before).alias(name) for name, r in zip(("i", "j"), t.ranks)],
        )
        for k, t in targets.items()
    ]
    held = values.select(F.inline(F.array(*inside))).where(F.col("v").isNotNull())
    ranked = held.groupBy("target", "i", "j", "v").count()
    w = Window.partitionBy("target").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("count").over(w)
    found = ranked.withColumn("upto", upto).groupBy("target").agg(
        F.min(F.when(F.col("upto") > F.col("i"), F.col("v"))).alias("first"),
        F.min(F.when(F.col("upto") > F.col("j"), F.col("v"))).alias("second"),
    )
    for row in found.collect():
        targets[row["target"]].found = (row["first"], row["second"])


def _order_statistics(column: DataFrame, n: int, i: int, j: int, direct_rows: int, accuracy: int):
    """Values at the 0-based ranks ``i <= j`` of ``n`` non-null rows."""
    first = _value_at(column, n, i, direct_rows, accuracy)
    return first, first if i == j else _value_at(column, n, j, direct_rows, accuracy)


def _value_at(column: DataFrame, n: int, rank: int, direct_rows: int, accuracy: int):
    """The value at one rank. Proposed cuts split the values into the cuts themselves and
    what lies between; exact counts say where the rank is, and that part is split anew.
    Cuts are values of the column, so a part shrinks in every step, whatever the values."""
    while n > direct_rows:
        grid = F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)])
        cuts = sorted(set(column.agg(F.percentile_approx("v", grid, F.lit(accuracy)).alias("q")).first()["q"]))
        known_cuts = F.array(*[F.lit(c) for c in cuts])
        part = 2 * F.size(F.filter(known_cuts, lambda c: c < F.col("v"))) + F.array_contains(known_cuts, F.col("v")).cast("int")
        # At most two rows for each cut.
        parts = column.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(parts.collect()):
            if rank < row["n"]:
                break
            rank -= row["n"]
        if row["low"] == row["high"]:
            return row["low"]
        column, n = column.where(F.col("v").between(row["low"], row["high"])), row["n"]
    # One row per distinct value: copies of a hot value were merged map-side.
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = column.groupBy("v").count().withColumn("upto", F.sum("count").over(w))
    return ranked.agg(F.min(F.when(F.col("upto") > rank, F.col("v")))).first()[0]
