"""Language identification in two steps: the family, then the language inside it."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_process, slices

#: Families of languages by ISO 639-1 code. Another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fo fy lb yi",
    "romance": "fr es pt it ro ca gl oc rm",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn ur pa gu mr ne si",
    "semitic": "ar he am mt",
    "celtic": "ga gd cy br",
    "sinitic": "zh",
}
FEATURES = 4096  # the hash below gives twelve bits
#: Learned from about this many documents of each language at most, drawn by a hash of
#: the row from all of them; a language with fewer than MIN_DOCS is not learned.
SAMPLE = 1500
MIN_DOCS = 5
#: Languages whose counts are sent to all tasks.
MOST_BROADCAST = 10_000
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), f"other:{lang}")


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)


def feature_counts(text: str) -> np.ndarray:
    """How often a whole text has each hashed run of one to three letters. Texts are
    lower-cased; what is no letter borders a run, and a border counts as a letter of runs
    of two and three (in three not in the middle)."""
    known = per_process("letters", _letters)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    codes = np.where(known[np.minimum(codes, len(known) - 1)], codes, np.uint32(0))
    letter = codes > 0
    mixed = codes * np.uint32(0x9E3779B1)
    two = (mixed[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + mixed[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + mixed[2:]
    runs = np.concatenate((mixed[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]))
    runs = (runs ^ (runs >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount((runs >> np.uint32(20)).astype(np.int64), minlength=FEATURES)


def _vector(text: str) -> SparseVector:
    """Relative frequencies of a whole text's features."""
    counts = feature_counts(text)
    at = np.flatnonzero(counts)
    return SparseVector(FEATURES, at, counts[at] / max(counts.sum(), 1))


@dataclass
class Model:
    """Linear scores: a row of ``weights`` for each family, then for each pair of
    languages of one family (positive: the first)."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, scores: np.ndarray) -> tuple[str, float]:
        """Language and certainty: the family's probability times the mean probability
        that the language beats its relatives. Votes decide, then certainty."""
        n = len(self.families)
        shares = np.exp(scores[:n] - scores[:n].max())
        shares /= shares.sum()
        best = int(shares.argmax())
        members = self.members[self.families[best]]
        wins, chances = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), margin in zip(self.pairs, scores[n:].tolist(), strict=True):
            if a in wins:
                chance = 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * margin))))
                wins[a if margin >= 0 else b] += 1
                chances[a] += chance
                chances[b] += 1 - chance
        lang = max(members, key=lambda m: (wins[m], chances[m], m))
        return lang, float(shares[best] * (chances[lang] / (len(members) - 1) if len(members) > 1 else 1.0))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang); those with a null text or
    language teach nothing. None if no language has ``MIN_DOCS`` documents."""
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    scratch = Scratch(docs.sparkSession, "language")
    counts = scratch.written(usable.groupBy("lang").count().where(F.col("count") >= MIN_DOCS), "counts")
    # Each language is drawn at the rate that gives about ``sample`` documents. Counts have a
    # row for each language; if they are few, texts stay where they are, and only what is
    # drawn is written. (With very many the join is by language.)
    known = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    drawn = usable.select("doc_id", "text", "lang").join(known, "lang").where(part * F.col("count") < sample)
    vector = F.udf(_vector, VectorUDT(), useArrow=False)  # on the sample only
    features = scratch.written(drawn.select("lang", vector("text").alias("features")), "sample")
    langs = sorted(r["lang"] for r in features.select("lang").distinct().collect())
    if not langs:
        return None
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family(lang), []).append(lang)
    families = sorted(members)
    rows, biases = [np.zeros(FEATURES) for _ in families], [0.0] * len(families)
    # A bounded sample: few partitions make each of the many short passes a single stage.
    small = features.coalesce(3)

    def target(groups: list[list[str]]) -> Column:
        index = F.lit(None).cast("double")
        for k, group in enumerate(groups):
            index = F.when(F.col("lang").isin(group), float(k)).otherwise(index)
        return index

    if len(families) > 1:
        labelled = small.withColumn("label", target([members[f] for f in families]))
        fit = LogisticRegression(family="multinomial", maxIter=25, regParam=0.001).fit(labelled)
        rows, biases = list(fit.coefficientMatrix.toArray()), fit.interceptVector.toArray().tolist()
    pairs = [p for f in families for p in itertools.combinations(members[f], 2)]
    for a, b in pairs:
        labelled = small.where(F.col("lang").isin([a, b])).withColumn("label", target([[b], [a]]))
        fit = LinearSVC(maxIter=25, regParam=0.01).fit(labelled)
        rows.append(fit.coefficients.toArray())
        biases.append(fit.intercept)
    return Model(families, members, pairs, np.array(rows), np.array(biases))


def text_scores(model: Model, text: str | None) -> np.ndarray | None:
    """The classifiers' scores of a whole text; None without a letter."""
    counts = feature_counts(text or "")
    total = counts.sum()
    return model.weights @ counts / total + model.bias if total else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text. ``und`` with score 0 stands for
    null and empty texts, texts without a letter, and an untaught model. Repeated rows
    are judged alike; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text in batch.column(1).to_pylist():
                scores = text_scores(model, text) if model else None
                found.append((UNKNOWN, 0.0) if scores is None else model.decide(scores))
            langs, certain = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(certain, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the rows that are not held out
    (a null doc_id is held out). An empty table gives no rows."""
    model = train(docs.where(~held_out(F.col("doc_id"))), sample)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
