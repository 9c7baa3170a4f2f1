"""From raw documents to packed sequences: five stages, each a written table for the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last returns the pieces of all documents with their places.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import packing, quality, secrets, simhash, suffix_dedup
from estatelens.llm.common import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close SimHash fingerprints: the one with the smallest doc_id.

    Fingerprints of three-word shingles link at three or fewer differing bits.
    """
    return simhash.keep_one(docs, words=3, bits=3)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words or of 400 bytes and more that stand elsewhere too.

    Only whole characters go: one that a passage begins or ends in the middle of stays.
    """
    return suffix_dedup.cut_repeats(docs, words=51)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

# Fingerprints need XXH64 and packing needs a tokenizer, which SQL lacks.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (_, stage) in enumerate(STAGES):
        name = f"stage{number}"
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs.select(*(F.col(c) for c in docs.columns))
