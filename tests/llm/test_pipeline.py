"""The pipeline's stages against plain versions of what they keep."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from sorrel.llm import packing, quality, similar, toxicity


def with_columns(df):
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))


def test_stages_keep_columns_and_take_effect(spark, sf_dir, odd_docs, labels):
    docs = with_columns(odd_docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert kept.count() <= docs.count()
    low = quality.classify(docs, labels, cut=corpus_pipeline.KEEP_QUALITY).where("predicted = 0").count()
    assert corpus_pipeline.keep_good(spark, docs, sf_dir).count() == docs.count() - low
    toxic = toxicity.score_toxicity(docs, toxicity.train(docs, labels), corpus_pipeline.DROP_TOXIC).where("toxic = 1").count()
    assert corpus_pipeline.drop_toxic(spark, docs, sf_dir).count() == docs.count() - toxic
    groups = similar.similar_documents(docs).select("component_id", "doc_id").collect()
    first = {r["component_id"] for r in groups if r["component_id"] is not None}
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).select("doc_id").collect()} - {None} == first


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == want
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).count()
    assert len(got) == pieces


def test_no_documents(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
