"""The corpus operators' queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm import bpe, divergence, importance, language_id, language_model, licenses, media, oracles, packing, quality, simhash, sketch, token_store, toxicity
from sorrel.llm.common import read_documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read_documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(read_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(cast(doc_id as string)) % 4 = 2"
    scored = quality.classify(read_documents(spark, sf_dir), _labels(spark, sf_dir), held_out)
    return scored.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(read_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_id.identify(docs, language_id.train(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_token_store, op3_byte_bpe, op4_lm_score, op5_fingerprints, op6_quality, op7_media, op8_simhash, op9_packing, op10_licenses, op11_language_id, op12_divergence, op13_resampling)}
#: The other operators' full results can't be expressed in SQL; each is tested against brute force, a round trip or held-out labels.
ORACLES: dict[str, str] = {"op12_divergence": oracles.DIVERGENCE, "op13_resampling": oracles.RESAMPLING}
