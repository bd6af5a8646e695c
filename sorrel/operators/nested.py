"""Leaves of nested documents of any shape, and the differences of two versions.

A document is a VARIANT that is opened level by level, in the JVM: each step explodes the containers of a level, and a
value that has no children stays. The number of steps is the documents' depth, not their size; STEPS of them are one pass
over the rows, and only what is deeper than that is written before it goes on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.session import kept

#: Levels that are opened in one plan.
STEPS = 12


def _token(key: Column) -> Column:
    """A key as part of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def depth_of(df: DataFrame, document: str) -> int:
    """The most brackets that stand open at once in any of the JSON texts, without those in strings."""
    bare = F.replace(F.replace(F.col(document).cast("string"), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.split(F.regexp_replace(F.regexp_replace(bare, '"[^"]*"', ""), r"[^\[\]{}]+", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, bracket: Column) -> Column:
        now = at["now"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return df.where(F.try_parse_json(F.col(document).cast("string")).isNotNull()).agg(F.max(F.aggregate(brackets, zero, step, lambda at: at["most"]))).first()[0] or 0


def leaves(df: DataFrame, keys: Sequence[str], document: str, members: Mapping[str, str] | None = None, depth: int | None = None) -> DataFrame:
    """keys, pointer (JSON pointer), kind and value (text) of every leaf of a column of JSON texts.

    kind is string, number, boolean, null, or object and array for empty ones. An element of an array has its index in
    the pointer; of an array under a key of `members` its value of the field that is given there, so that elements keep
    their pointers when others come and go (an element without that field has its index). A text that isn't JSON, or
    null, has no leaves. Keys may repeat: each row is a document. The documents' depth is looked up first, in a pass over
    df, unless it is given; a document that is deeper than what is given is an error when it is read.
    """
    spark, members = df.sparkSession, dict(members or {})
    left = depth_of(df, document) if depth is None else depth

    def opened(level: DataFrame) -> DataFrame:
        met = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
        named = [F.when(F.col("_under") == k, F.try_variant_get("value", f"$.{v}", "string")) for k, v in members.items()]
        step = F.when(F.col("key").isNotNull(), _token(F.col("key"))).otherwise(F.coalesce(*(_token(n) for n in named), F.col("pos").cast("string")))
        inner = F.col("pos").isNotNull()
        # The key under which a value stands: what an array's elements are looked up by in `members`.
        values = {"_pointer": F.when(inner, F.concat("_pointer", F.lit("/"), step)).otherwise(F.col("_pointer")), "_under": F.when(inner, F.col("key")), "_v": F.when(inner, F.col("value")).otherwise(F.col("_v"))}
        return met.select(*(F.col(f"_key_{i}") for i in range(len(keys))), *(v.alias(k) for k, v in values.items()))

    # Keys have names of their own here, as what is opened has a pos, a key and a value.
    level = df.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.lit("").alias("_pointer"), F.lit(None).cast("string").alias("_under"), F.try_parse_json(F.col(document).cast("string")).alias("_v"))
    schema = F.schema_of_variant("_v")
    container = (schema.startswith("OBJECT") & (schema != "OBJECT<>")) | (schema.startswith("ARRAY") & F.try_variant_get("_v", "$[0]", "variant").isNotNull())
    kind = F.when(schema == "VOID", "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("number")
    value = F.when(schema.startswith("OBJECT"), "{}").when(schema.startswith("ARRAY"), "[]").otherwise(F.try_variant_get("_v", "$", "string"))
    done: list[DataFrame] = []
    while True:
        for _ in range(min(left, STEPS)):
            level = opened(level)
        left -= STEPS
        leaf = level.where("_v IS NOT NULL")
        if left > 0:
            level = kept(level, "level")
            leaf = level.where(~container & F.col("_v").isNotNull())
            level = level.where(container)
        if depth is not None and left <= 0:
            kind = F.when(container, F.raise_error(F.lit(f"a document is deeper than {depth}"))).otherwise(kind)
        done.append(leaf.select(*(F.col(f"_key_{i}").alias(k) for i, k in enumerate(keys)), F.col("_pointer").alias("pointer"), kind.alias("kind"), value.alias("value")))
        if left <= 0:
            return reduce(DataFrame.unionByName, done)


def _differences(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys, pointer, old and new (structs of kind and value, null where there is no such leaf) that are a change."""
    some = lambda c: F.coalesce(F.col(f"{c}.value").isNotNull(), F.lit(False))
    none = lambda c: F.col(c).isNull()
    change = F.when(none("old") & some("new"), "added").when(none("new") & some("old"), "removed").when(~none("old") & ~none("new") & ~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "pointer", "change", F.col("old.value").alias("old"), F.col("new.value").alias("new"))


def leaf_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pointer, change (added, removed, changed) and old and new values of leaves that differ, by pointer.

    old and new are rows of `leaves`, one document a key. Null and empty containers count as no value: a leaf that is
    null on one side and missing on the other is no change.
    """
    side = lambda x, name: x.where("kind NOT IN ('object', 'array')").select(*keys, "pointer", F.struct("kind", "value").alias(name))
    return _differences(side(old, "old").join(side(new, "new"), [*keys, "pointer"], "full"), keys)


def document_changes(df: DataFrame, keys: Sequence[str], old: str, new: str, members: Mapping[str, str] | None = None, depth: int | None = None) -> DataFrame:
    """`leaf_changes` of two documents that stand in one row, columns old and new; one row a key.

    Leaves meet in a group by keys and pointer, so if rows are dealt by their keys already, no leaf is moved.
    """
    sides = df.select(*keys, F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col(old).alias("doc")), F.struct(F.lit("new").alias("side"), F.col(new).alias("doc")))).alias("x")).select(*keys, F.col("x.side").alias("_side"), F.col("x.doc").alias("_doc"))
    rows = leaves(sides, [*keys, "_side"], "_doc", members, depth).where("kind NOT IN ('object', 'array')")
    of = lambda name: F.collect_list(F.when(F.col("_side") == name, F.struct("kind", "value"))).alias(name)
    both = rows.groupBy(*keys, "pointer").agg(of("old"), of("new"))
    # A pointer that a document has twice, by equal fields of elements, meets each one of the other side, as in a join.
    both = both.withColumn("old", F.explode_outer("old")).withColumn("new", F.explode_outer("new"))
    return _differences(both, keys)
