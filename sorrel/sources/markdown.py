"""Markdown documents: front matter, headed sections and their paragraphs, all in Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FENCED = r"(?s)^﻿?---\r?\n(.*?)\r?\n---\r?\n?(.*)$"


def split_documents(files: DataFrame) -> DataFrame:
    """Rows with a column value, a whole file, with front (text of the front matter), body and error in its place."""
    good = F.col("value").rlike(_FENCED)
    return files.withColumn("front", F.when(good, F.regexp_extract("value", _FENCED, 1))).withColumn("body", F.when(good, F.regexp_extract("value", _FENCED, 2))).withColumn("error", F.when(~good, "no front matter")).drop("value")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, front (text of the front matter), body, error of each file below path."""
    return split_documents(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def front_value(front: Column, name: str) -> Column:
    """A plain value of the front matter, quotes removed; null if the key isn't there."""
    line = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(front.rlike(rf"(?m)^{name}:"), F.regexp_replace(line, "^[\"'](.*)[\"']$", "$1"))


def kind_of(path: Column, kinds: dict[str, str]) -> Column:
    """The kind whose pattern fits the path first."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(kinds.items()):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def sections(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, place, heading, text of second-level sections; headings inside code fences don't count.

    Lines are numbered, fences and headings counted along them, and each section's lines gathered, so the work is in
    proportion to a document's lines; what stands before the first heading is left out.
    """
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(body, "\r", ""), "\n")).alias("at", "line"))
    along = Window.partitionBy(key).orderBy("at")
    fence = F.col("line").startswith("```").cast("int")
    fenced = (F.sum(fence).over(along) - fence) % 2 == 1
    marked = lines.withColumn("head", (~fenced & F.col("line").startswith("## ")).cast("int"))
    parts = marked.withColumn("place", F.sum("head").over(along) - 1).where("place >= 0").groupBy(key, "place").agg(F.sort_array(F.collect_list(F.struct("at", "head", "line"))).alias("lines"))
    heading = F.expr("substring(lines[0].line, 4)")
    text = F.array_join(F.transform(F.expr("slice(lines, 2, size(lines))"), lambda x: x["line"]), "\n")
    return parts.select(key, F.col("place").cast("int").alias("place"), F.trim(heading).alias("heading"), F.trim(F.regexp_replace(text, "^\n+|\n+$", "")).alias("text"))


def split_quiz(body: Column, heading: str) -> tuple[Column, Column]:
    """The text before a heading and the text after it (null without it)."""
    at = F.instr(F.concat(F.lit("\n"), body), F.lit(f"\n## {heading}\n"))
    return F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body), F.when(at > 0, F.substring(body, at + len(heading) + 4, F.length(body)))
