"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (bpe, chat, cotraining, exact_dedup, mixing, ngram_join, packing, quality_rules, secrets, sharding, vector_codes,
               warc, whitening)
from .common import table
from .oracles import ORACLES


def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return cotraining.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_strings(docs)))


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf, "pages"), path)
    return warc.pages_of(warc.read_archive(spark, path)).drop("url")


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"), 16)


def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat.rotate(table(spark, sf, "conversations"))


def op8_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents")).drop("_md5")


def op9_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf, "documents"), keep="largest").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(table(spark, sf, "documents")))
    return tokens.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf, "embeddings"))
    return vector_codes.label_errors(coded).select(
        "vec_id", vector_codes.code_text("code").alias("code"), "error", "label_error",
        F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_classifier, op2_best_fit_packing, op3_secret_scan, op4_warc, op5_quality_rules, op6_sharding,
    op7_chat_formatting, op8_ngram_join, op9_source_mix, op10_exact_dedup, op11_byte_level_bpe, op12_embedding_whitening, op13_vector_codes)}

__all__ = ["ORACLES", "QUERIES"]
