"""Text expressions. All are plain Columns, so they stay in generated code.

Character classes are spelled out instead of using ``\\s``, ``\\w`` and
``\\b``: their meaning differs between regex engines and JDK releases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
WORD = r"\p{L}\p{N}_"

# Spellings given a canonical form wherever they occur in a type.
TYPE_WORDS = ("Indoor", "Outdoor", "Warung", "Cafe", "Mix")

# Generic words that carry no identity in a match key.
GENERIC_WORDS = ("restoran", "warung", "cafe", "kedai", "rumah makan", "rm", "depot")

# Punctuation that is dropped from a match key.
KEY_PUNCTUATION = """.,;:!?()[]{}"'-"""


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.trim(_col(c), F.lit(SPACES))


def collapse(c) -> Column:
    """Turn every run of whitespace into one blank, none at either end."""
    return F.trim(F.regexp_replace(_col(c), f"[{SPACE}]+", " "))


def canonical_type(c) -> Column:
    """Strip, then rewrite known type words to their canonical casing."""
    out = strip(c)
    for word in TYPE_WORDS:
        out = F.regexp_replace(out, f"(?iu){word.lower()}", word)
    return out


def match_key(c) -> Column:
    """Key under which two spellings of one place compare equal; never null."""
    out = collapse(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))))
    out = F.translate(out, KEY_PUNCTUATION, "")
    # Looking at one letter first spares the costlier tests almost everywhere.
    words, initials = "|".join(GENERIC_WORDS), "".join(sorted({w[0] for w in GENERIC_WORDS}))
    out = F.regexp_replace(out, f"(?=[{initials}])(?<![{WORD}])(?:{words})(?![{WORD}])", "")
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def clean_text(c) -> Column:
    """Collapse whitespace and drop all but words and basic punctuation."""
    out = collapse(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.regexp_replace(out, rf"[^{WORD}{SPACE}.,!?()\-]+", "")


def contains_text(c, query: str, regex: bool = False) -> Column:
    """Case-insensitive containment; a null text never matches."""
    hit = (
        F.regexp_like(_col(c), F.lit(f"(?iu){query}"))
        if regex
        else F.contains(F.lower(_col(c)), F.lower(F.lit(query)))
    )
    return F.coalesce(hit, F.lit(False))


def same_text(c, value: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(_col(c)) == F.lower(F.lit(value))


def in_text_list(c, values: str) -> Column:
    """Case-insensitive membership in a comma-separated list."""
    return F.lower(_col(c)).isin([v.strip().lower() for v in values.split(",")])


def is_link(c) -> Column:
    return F.startswith(_col(c), F.lit("http"))
