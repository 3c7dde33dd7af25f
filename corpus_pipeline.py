"""From raw documents to packed training sequences, in five stages.

Each stage takes all documents that the one before it kept and returns the columns of documents; the
last returns packed pieces with their ids. `run` writes each stage's result into the cluster's shared
folder and reads it again for the next one, so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, pii, quality
from tidemark.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base limits or a cutoff proven on labels. A null or empty text fails."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near duplicates (five-word shingles, Jaccard 0.8)."""
    return jaccard.one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites personal data in the texts; n_chars follows a text that changes its length. No row is dropped."""
    rewritten = pii.pseudonymised(docs)
    n_chars = F.when(F.col("pii_found") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    columns = [n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return rewritten.select(*columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of sources asks, which may be never; a row for each time."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 ids: a row for each piece, with its ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii", pseudonyms),
    ("mixing", mixing_sources),
    ("packing", packed),
]

#: Features, similarity joins, pseudonyms and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
