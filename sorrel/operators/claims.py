"""Claims in texts and their verdicts against facts of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of claims by pattern, RE2-compatible.
PATTERNS = {
    "url": r"https?://[A-Za-z0-9./?=&_%:~-]+",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "number": r"[0-9][0-9,]*(?:[.][0-9]+)?",
}


def extract_claims(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows key, kind, claim (its text), place (from 0 within its kind) for every claim; urls and dates are masked before numbers."""

    def of_kind(kind: str, text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda c, i: F.struct(F.lit(kind).alias("kind"), c.alias("claim"), i.alias("place")))

    masked, found = F.col(text), []
    for kind, pattern in PATTERNS.items():
        found.append(of_kind(kind, masked))
        masked = F.regexp_replace(masked, pattern, "\u0001")
    return docs.select(key, F.explode(F.concat(*found)).alias("c")).select(key, "c.*")


def check_numbers(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """A verdict for each claim (claim_id, source, label, value, tolerance) by facts (source, label, value).

    grounded: a fact of its source and label lies within the tolerance; contradiction: there are facts, but none does;
    unsupported: there is no such fact. Facts are reduced to distinct values before the join.
    """
    known = facts.select("source", "label", F.col("value").alias("fact")).where("fact is not null").distinct()
    met = claims.join(known, ["source", "label"], "left")
    near = F.coalesce(F.abs(F.col("fact") - F.col("value")) <= F.col("tolerance"), F.lit(False))
    by = met.groupBy("claim_id").agg(F.bool_or(near).alias("near"), F.count("fact").alias("n"))
    return by.select("claim_id", F.when(F.col("near"), "grounded").when(F.col("n") > 0, "contradiction").otherwise("unsupported").alias("verdict"))


def unacknowledged(results: DataFrame, acks: DataFrame) -> DataFrame:
    """Results (file, print, verdict) that are neither grounded nor acknowledged for their file or for all (a null file)."""
    anywhere = acks.where("file is null").select("print").distinct()
    here = acks.where("file is not null").select("file", "print").distinct()
    return results.where("verdict <> 'grounded'").join(anywhere, "print", "left_anti").join(here, ["file", "print"], "left_anti")
