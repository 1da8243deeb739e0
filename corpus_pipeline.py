"""The text pipeline: quality rules, exact dedup, near dedup, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sizeladder.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from sizeladder.llm.common import table
from sizeladder.session import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text: the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near duplicates: the smallest doc_id."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source mix takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("source_mix", mix),
          ("best_fit_packing", pack)]

#: The quality rules' expectation-maximisation and the tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
