"""Corpus pipeline: four stages, each one operator of sorrel.llm, from documents to packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm import packing, quality, similar, toxicity
from sorrel.llm.common import Bits, free_name, salted_join, stored

#: A document whose quality score is lower goes; lower than the classifier's own cut, so that clean documents stay.
KEEP_QUALITY = 0.3
#: A document with this chance of a grade over 0 goes; README has the figures of both cuts on held-out rows.
DROP_TOXIC = 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null, empty and very long texts are scored as any; repeated rows and rows without an id are each judged by their own
    text; a score that equals the cut stays; no documents give no rows; all columns stay, whatever their names.
    """
    return quality.accepted(docs, _labels(spark, sf_dir), KEEP_QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't flag.

    Null, empty and very long texts are scored as any; repeated rows and rows without an id are each judged by their own
    text; a chance that equals the cut goes; no documents give no rows; all columns stay, whatever their names.
    """
    return toxicity.clean_rows(docs, toxicity.train(docs, _labels(spark, sf_dir)), DROP_TOXIC)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a Jaccard similarity of 0.8 or more over five-word shingles connect.

    The one with the smallest id stays, a null id after all others; of rows with equal ids the first in the table. Null
    and empty texts are one group; no documents give no rows; all columns stay as they are, whatever their names.
    """
    row = free_name(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = similar.similar_documents(rows.select(F.col(row).alias("doc_id"), "text"))
    named = stored(groups.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, "doc_id"), row), "groups")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("component_id", F.col(f"first.{row}").alias("first"))
    others = stored(salted_join(named, first, "component_id").where(F.col(row) != F.col("first")).select(row), "others")
    # Texts move only where a map of bits can't tell that their row stays.
    key = free_name(rows, "hash")
    rows = rows.withColumn(key, F.xxhash64(row))
    mark = free_name(rows, "mark")
    marked = Bits(others.select(F.xxhash64(row).alias(key)), key).marked(rows, key, mark)
    kept = marked.where(~F.col(mark)).unionByName(marked.where(mark).join(others, row, "left_anti").select(*marked.columns))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null or empty text is one piece of the end id; very long texts are cut into pieces; repeated rows are packed each;
    pieces of one length go to any of the places for it; no documents give no rows; other columns are ignored.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("packing", pack)]
#: Trained models and tokenizers can't be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
