"""Documents with every kind of odd row: nulls, empty and long texts, repeats, odd white space, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

ODD = [
    (100000, None), (100001, ""), (100002, " \t\n "), (100003, "a"), (100004, "Hello  world\n\n\n  x"), (100005, "　\x85\x1c wide spaces ​<|endoftext|> 's don't 12,345"),
    (100006, "é ß 漢字 かな 😀😀 é " * 3), (100007, "no newline at end \n"), (100007, "no newline at end \n"), (None, "a text without an id"), (None, None), (-5, "negative id, MIT License; CC BY 4.0"),
    (100008, "word " * 5000), (100009, "x" * 30000), (100010, " ".join(f"w{i % 977}x{i % 31}" for i in range(20000))), (100011, "Apache License Apache License\nGNU general public LICENSE"), (100012, "\x00\x01 control \x7f"), (100013, "a <|endoftext|> b\n<|startoftext|>c <|ENDOFTEXT|>"), (100014, "<|endoftext|>"),
]
CLASHING = ["anchor", "fp", "block", "bucket", "rank", "words", "stats", "place", "key", "media", "lang2"]


@pytest.fixture(scope="session")
def odd_docs(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = plain.union(spark.createDataFrame(ODD, "doc_id long, text string")).repartition(5)
    return df.select(*(F.lit("x").alias(c) for c in CLASHING), "text", "doc_id").cache()


@pytest.fixture(scope="session")
def rows(odd_docs):
    """(doc_id, text) of all rows, a null text as an empty one."""
    return [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
