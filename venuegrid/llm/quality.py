"""Quality rules: fixed limits and robust multivariate outliers, in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, row_key, without, words

#: Low bits of a packed window that hold its place; the others hold bits of its hash.
_PLACE_BITS = 26

#: Transformed statistics, and the deviation that a group is given at least in each, as most
#: of them do not vary at all among most texts. Small against the range, so that each can reject.
FEATURES = {"log_words": 0.7, "log_word_length": 0.08, "log_symbols": 0.5, "dup_line_share": 0.1, "repeat_share": 0.06}
#: Part of the least variance that is added to each, so that no matrix is singular.
RIDGE = 0.01
#: Share of a group that the determinant is minimised over.
SUBSET = 0.75
STEPS = 3
#: A smaller group is judged by its language's estimate, a smaller language by none.
MIN_GROUP = 50
#: Chance that a row of a normal population is rejected.
TAIL = 1e-6


def _chi_square(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom."""
    term = total = math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
    n = k / 2 + 1
    while term > 1e-17 * total:
        term *= x / 2 / n
        total += term
        n += 1
    return total


def _chi_square_upper(tail: float, k: int) -> float:
    """The x that chi-square exceeds with probability ``tail``."""
    low, high = 1e-9, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - _chi_square(middle, k) > tail else (low, middle)
    return high


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Null text counts as empty. Every count is over the whole text and stays inside its
    row: nothing is exploded or shuffled. Repeated 3-word windows are found by sorting
    the windows' hashes with their places in the low bits, so that equal ones meet;
    the work is n log n in the words of a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    first = docs.select(
        *keep,
        F.length(plain).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        words(F.col("text")).alias("_words"),
    )
    w = F.col("_words")
    windows = F.when(
        F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    second = first.select(
        *keep,
        "word_chars",
        "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    h = F.col("_windows")
    packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, _PLACE_BITS).bitwiseOR(i.cast("long"))))
    third = second.withColumn("_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), packed))
    s, mask = F.col("_sorted"), (1 << _PLACE_BITS) - 1

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask)).cast("int")

    def same(x: Column, j: Column) -> Column:
        other = F.get(s, j)
        near = F.shiftright(x.bitwiseXOR(other), _PLACE_BITS) == 0
        return F.coalesce(near & (F.get(h, place(x)) == F.get(h, place(other))), F.lit(False))

    places = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), place))
    fourth = third.withColumn("_places", places).drop("_sorted", "_windows")
    p = F.col("_places")
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p("n_words"),
        "log_word_length": F.log1p(F.col("word_chars") / n),
        "log_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
    }


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from a group's centre m_* and whitening rows w_*_*."""
    total = F.lit(0.0)
    for i in range(len(names)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}"))
        total = total + z * z
    return total


def _whitened(moments: DataFrame, names: list[str], scale: float) -> DataFrame:
    """Replace covariances c_i_j by the inverse of their Cholesky factor, w_i_j, and add
    the determinant's logarithm. No variance is below its statistic's least one, so that a
    statistic that never varies in a group has an inverse as well."""
    n = len(names)
    df = moments
    for i, name in enumerate(names):
        df = df.withColumn(f"c_{i}_{i}", F.greatest(scale * F.col(f"c_{i}_{i}"), F.lit(FEATURES[name] ** 2)) + RIDGE * FEATURES[name] ** 2)
    for i in range(n):
        for j in range(i + 1):
            rest = F.col(f"c_{j}_{i}") * (1.0 if i == j else scale)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    for i in range(n):
        for j in range(i + 1):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
            df = df.withColumn(f"w_{i}_{j}", rest / F.col(f"l_{i}_{i}"))
    determinant = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(n)), F.lit(0.0))
    kept = [c for c in df.columns if c[:2] in ("g_", "m_", "w_", "n_")]
    return df.select(*kept, determinant.alias("g_det"))


def _moments(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)),
        *(F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs),
    )


def robust_estimates(rows: DataFrame, steps: int = STEPS, min_group: int = MIN_GROUP, scratch: Scratch | None = None) -> DataFrame:
    """Minimum-covariance-determinant centre and whitening matrix of each language and
    source, and of each language (``g_source`` null and ``g_level`` 0).

    ``rows`` has g_lang, g_source and the features. Two starts, around medians and
    around means, are concentrated by ``steps`` steps: keep the three quarters of the
    group with the smallest distances, estimate anew. The start with the smaller
    determinant wins. Each step is two partially aggregated passes over narrow rows;
    a group is never gathered, whatever its size.
    """
    scratch = scratch or Scratch(rows.sparkSession, "mcd")
    names = list(FEATURES)
    levels = rows.select(
        "g_lang", F.explode(F.array(F.struct(F.lit(0).alias("l"), F.lit(None).cast("string").alias("s")), F.struct(F.lit(1).alias("l"), F.col("g_source").alias("s")))).alias("g"), *names
    ).select("g_lang", F.col("g.l").alias("g_level"), F.col("g.s").alias("g_source"), *names)
    by = ["g_lang", "g_level", "g_source"]
    middle = levels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, n in enumerate(names)),
    )
    middle = middle.where(F.col("n_rows") >= min_group)
    robust = middle.select(
        *by,
        F.lit(0).alias("g_start"),
        *(F.col(f"q_{i}")[1].cast("double").alias(f"m_{i}") for i in range(len(names))),
        *(
            (1 / F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FEATURES[n])) if i == j else F.lit(0.0)).alias(f"w_{i}_{j}")
            for i, n in enumerate(names)
            for j in range(i + 1)
        ),
    )
    plain = _whitened(_moments(levels, names, *by).where(F.col("n_rows") >= min_group), names, 1.0)
    state = robust.unionByName(plain.withColumn("g_start", F.lit(1)).drop("n_rows", "g_det"))
    cut = _chi_square_upper(1 - SUBSET, len(names))
    scale = SUBSET / _chi_square(cut, len(names) + 2)
    keys = [*by, "g_start"]
    for _ in range(steps):
        near = _matched(levels, scratch.written(state, "mcd-state"), by).withColumn("d", _distance(names)).select(*keys, "d", *names)
        limits = near.groupBy(*keys).agg(F.percentile_approx("d", SUBSET, 1000).alias("limit"))
        subset = _matched(near, scratch.written(limits, "mcd-limits"), keys).where("d <= limit")
        state = _whitened(_moments(subset, names, *keys), names, scale).drop("n_rows")
    best = scratch.written(state, "mcd-best")
    chosen = best.groupBy(*by).agg(F.min_by("g_start", F.struct("g_det", "g_start")).alias("g_start"))
    return _matched(best, chosen, [*by, "g_start"]).drop("g_start", "g_det")


def _matched(rows: DataFrame, estimates: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe inner join with the estimates. They have a few rows for each source; Spark
    broadcasts them only if their files are below its own limit, else splits hot keys."""
    renamed = estimates.withColumnsRenamed({c: f"{c}_e" for c in by})
    same = [rows[c].eqNullSafe(renamed[f"{c}_e"]) for c in by]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.join(renamed, condition).drop(*(f"{c}_e" for c in by))


def judge_quality(docs: DataFrame, steps: int = STEPS, min_group: int = MIN_GROUP, tail: float = TAIL, keep: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None) -> DataFrame:
    """One row a document: ``keep``, the statistics, base_failed, distance and kept.

    A document is rejected if it fails the base limits or lies farther from its group's
    robust centre than all but ``tail`` of a normal population would. Estimates come
    from all documents that pass the base limits; null language and null source are
    groups of their own. Texts that are null or empty fail the base limits; repeated rows
    count each; an empty table gives no rows; ``distance`` is null without an estimate,
    and then the base limits alone decide.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    statistics = text_statistics(docs.select(*keep, F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "text"), *keep, "g_lang", "g_source")
    rows = scratch.written(statistics.withColumns(_features()).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "quality-rows")
    names = list(FEATURES)
    estimates = scratch.written(robust_estimates(rows.where("NOT base_failed").select("g_lang", "g_source", *names), steps, min_group, scratch), "mcd")
    scratch.keep_only(rows, estimates)
    own = estimates.where("g_level = 1").drop("g_level")
    general = estimates.where("g_level = 0").drop("g_level", "g_source")
    one = _joined(rows, own, ["g_lang", "g_source"]).withColumn("_own", _distance(names)).drop(*(c for c in own.columns if c[:2] in ("m_", "w_")))
    both = _joined(one, general, ["g_lang"]).withColumn("distance", F.sqrt(F.coalesce("_own", _distance(names))))
    limit = math.sqrt(_chi_square_upper(tail, len(names)))
    return both.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"),
    )


def _joined(rows: DataFrame, estimates: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe left join."""
    renamed = estimates.withColumnsRenamed({c: f"{c}_e" for c in by})
    condition = rows[by[0]].eqNullSafe(renamed[f"{by[0]}_e"])
    for c in by[1:]:
        condition = condition & rows[c].eqNullSafe(renamed[f"{c}_e"])
    return rows.join(renamed, condition, "left").drop(*(f"{c}_e" for c in by))


def keep_good(docs: DataFrame, steps: int = STEPS, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """``docs`` without those that ``judge_quality`` rejects; rows and columns as they were.

    Verdicts are on narrow rows, a hash of text, language and source in each: texts are read
    again, not written or moved. Null and empty texts, repeated rows and empty tables are
    judged as there.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    decides = ("text", "lang", "source")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(*decides).alias("hash"), *decides)
    judged = judge_quality(narrow, steps, min_group, tail, ("doc_id", "hash"), scratch)
    rejected = scratch.written(judged.where("NOT kept").select("doc_id", "hash").distinct(), "rejected")
    scratch.keep_only(rejected)
    return without(docs, rejected, *decides)
