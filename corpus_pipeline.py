"""A corpus pipeline of five operators: quality, near duplicates, benchmark leaks, secrets,
packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from venuegrid.llm.common import Scratch, table
from venuegrid.llm.decontamination import decontaminate
from venuegrid.llm.jaccard import keep_first
from venuegrid.llm.packing import pack_documents
from venuegrid.llm.quality import keep_good
from venuegrid.llm.queries import END_ID, TOKENIZER
from venuegrid.llm.secrets import scan_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return scan_secrets(docs, redact=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return pack_documents(docs, TOKENIZER, END_ID)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]

#: SQL expresses neither the robust estimates nor the tokenizer; the stages are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again, and
    what the stage before it wrote is then deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
