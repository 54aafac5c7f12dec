"""Declarative value rules, checked as one expression per rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import NUMERIC
from .text import SPACE, strip

INTEGER = rf"^[{SPACE}]*[+-]?[0-9]+[{SPACE}]*$"


# The messages of violated rules below are fixed values.
@dataclass(frozen=True)
class Rule:
    """What a column must satisfy. ``kind`` is int, float, string or list;
    minima and maxima limit numbers, lengths limit texts and lists; a pattern
    must match from the start of the text."""

    column: str
    kind: str
    required: bool = False
    min_value: float | None = None
    max_value: float | None = None
    min_length: int = 0
    max_length: int | None = None
    pattern: str | None = None

    def message(self, numeric: bool = False) -> Column:
        """The first violated condition as a text, or null when all hold.
        ``numeric`` says that the column already holds numbers."""
        c = F.col(self.column)
        text = c.cast("string") if self.kind != "list" else None
        empty = c.isNull() if self.kind == "list" else c.isNull() | (strip(text) == F.lit(""))
        out = F.when(empty, F.lit("Value is required") if self.required else F.lit(None).cast("string"))
        if self.kind in ("int", "float"):
            checks = self._number(c, None if numeric else text)
        elif self.kind in ("string", "list"):
            checks = self._string(text) if self.kind == "string" else self._list(c)
        else:
            return out.otherwise(F.lit(f"Unknown input type: {self.kind}"))
        for violated, reason in checks:
            out = out.when(violated, F.lit(reason))
        return out

    def _number(self, c: Column, text: Column | None):
        if text is None:
            value = c.try_cast("long") if self.kind == "int" else c.cast("double")
            if self.kind == "int":
                yield c.isNotNull() & value.isNull(), "Invalid integer value"
        else:
            pattern, word = (INTEGER, "integer") if self.kind == "int" else (NUMERIC, "float")
            yield ~F.regexp_like(text, F.lit(pattern)), f"Invalid {word} value"
            value = F.trim(text).try_cast("double")
        if self.min_value is not None:
            yield value < self.min_value, f"Value must be at least {self.min_value}"
        if self.max_value is not None:
            yield value > self.max_value, f"Value must be at most {self.max_value}"

    def _string(self, text: Column):
        value = strip(text)
        yield F.length(value) < self.min_length, f"String must be at least {self.min_length} characters"
        if self.max_length:
            yield F.length(value) > self.max_length, f"String must be at most {self.max_length} characters"
        if self.pattern:
            yield ~F.regexp_like(value, F.lit(f"^(?:{self.pattern})")), "String format is invalid"

    def _list(self, c: Column):
        yield F.size(c) < self.min_length, f"List must have at least {self.min_length} items"
        if self.max_length:
            yield F.size(c) > self.max_length, f"List must have at most {self.max_length} items"


def violations(df: DataFrame, rules: list[Rule]) -> Column:
    """Array of ``column: message`` texts, empty for a valid row."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    texts = [F.concat(F.lit(f"{r.column}: "), r.message(r.column in numeric)) for r in rules]
    return F.array_compact(F.array(*texts))
