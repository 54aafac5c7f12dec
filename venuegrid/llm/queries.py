"""Registered queries of this subpackage; each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_counts
from .common import id_crc, run_folder, table
from .decontamination import contaminated
from .jaccard import near_duplicates
from .language import identify
from .lattice import score_documents
from .packing import pack_documents
from .prefix_trie import conversation_trie
from .quality import judge_quality
from .secrets import scan_secrets
from .sharding import shard_documents
from .simhash import simhash_groups
from .token_files import read_tokens, token_digest, write_tokens
from .url_rules import judge_urls

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2

BYTE_PAIRS = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "consistency", "n_slots")


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"), shards=16)


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Labels judge documents; a page has the label of the document with its number:
    of low quality or toxic means blocked."""
    blocked = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = table(spark, folder, "labels").where("quality IS NOT NULL OR toxic IS NOT NULL")
    labels = known.select(F.col("doc_id").alias("page_id"), blocked.alias("blocked"))
    return judge_urls(table(spark, folder, "pages"), labels, URL_RULES)


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents"))


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = run_folder(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, TOKENIZER, END_ID)
    return token_digest(read_tokens(spark, path))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), TOKENIZER, END_ID)


def lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), id_crc(F.col("doc_id")) % 7 != 2, PIECES)


def simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_groups(table(spark, folder, "documents"))


def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, folder, "conversations"))


def alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers over every whole text."""
    return alignment_counts(table(spark, folder, "documents"), BYTE_PAIRS, PIECES)


QUERIES: dict[str, Query] = {
    "op1_decontamination": decontamination,
    "op2_language": language,
    "op3_jaccard_join": jaccard_join,
    "op4_sharding": sharding,
    "op5_url_rules": url_rules,
    "op6_token_output": token_output,
    "op7_quality_rules": quality_rules,
    "op8_packing": packing,
    "op9_secret_scan": secret_scan,
    "op10_lattice_score": lattice_score,
    "op11_simhash": simhash,
    "op12_prefix_trie": prefix_trie,
    "op13_alignment": alignment,
}
CHECKS: dict[str, str] = {}
