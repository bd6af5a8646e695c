"""Data-quality rules: each gives problems as rows (file, key, rule, severity)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_rules(df: DataFrame, file: str, key: Column, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """All rules (name, condition of a problem, severity) of a table in one pass; a null condition is no problem."""
    found = F.filter(F.array(*(F.when(bad, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, bad, severity in rules)), lambda x: x.isNotNull())
    return df.select(F.lit(file).alias("file"), key.cast("string").alias("key"), F.explode(found).alias("p")).select("file", "key", "p.rule", "p.severity")


def missing_targets(df: DataFrame, column: str, targets: DataFrame, target: str, file: str, rule: str, severity: str = "error") -> DataFrame:
    """Rows whose reference isn't in targets; null references are no problem."""
    known = targets.select(F.col(target).alias(column)).distinct()
    bad = df.where(F.col(column).isNotNull()).join(known, column, "left_anti")
    return bad.select(F.lit(file).alias("file"), F.col(column).cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def repeated(df: DataFrame, key: Column, file: str, rule: str, severity: str = "error") -> DataFrame:
    """Keys that stand more than once, one problem each."""
    return df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(file).alias("file"), "key", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def all_problems(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def schema_rules(schema: dict, prefix: str = "") -> list[tuple[str, Column, str]]:
    """Rules for row_rules from a JSON Schema of an object: required, type of text, enum, pattern, bounds, lengths; nested objects too."""
    out: list[tuple[str, Column, str]] = []
    for name in sorted(schema.get("properties", {})):
        rule, path = schema["properties"][name], f"{prefix}{name}"
        value = F.col(path)
        if name in schema.get("required", []):
            out.append((f"{path}: required", value.isNull(), "error"))
        if "enum" in rule:
            out.append((f"{path}: enum", value.isNotNull() & ~value.isin(*rule["enum"]), "error"))
        if "pattern" in rule:
            out.append((f"{path}: pattern", ~value.rlike(rule["pattern"]), "error"))
        for key, bad in (("minimum", lambda v, n: v < n), ("maximum", lambda v, n: v > n), ("minLength", lambda v, n: F.length(v) < n), ("maxLength", lambda v, n: F.length(v) > n), ("maxItems", lambda v, n: F.size(v) > n)):
            if key in rule:
                out.append((f"{path}: {key}", bad(value, rule[key]), "error"))
        if rule.get("type") == "object":
            out += schema_rules(rule, f"{path}.")
    return out
