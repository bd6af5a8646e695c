"""Merging documents into a current state with an audit trail.

Truth follows the order of the sources (time of submission, then id), never that of arrival, so any order of input gives
the same state. An amount that equals the older one within its unit's coarseness keeps the older, more precise value;
that isn't transitive, so each cell is folded in order. A cell's versions are as many as documents that restate it, which
is a handful; they are folded inside Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded_cells(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, source: str, coarse: Column, width: Column) -> DataFrame:
    """keys, value, source, n_revisions and revisions (at, old, new) of each cell after all its versions.

    A version that says nothing (null) changes nothing. One that differs from the present value by less than width,
    where coarse holds, leaves it as it is.
    """
    version = F.struct(*order, F.col(value).alias("_value"), F.col(source).alias("_source"), F.coalesce(coarse, F.lit(False)).alias("_coarse"), width.alias("_width"))
    kind, id_kind = dict(rows.dtypes)[value], dict(rows.dtypes)[source]
    entry = f"array<struct<source:{id_kind},old:{kind},new:{kind}>>"
    start = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(None).cast(id_kind).alias("source"), F.array().cast(entry).alias("revisions"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["source"].isNull()
        same = (acc["value"] == x["_value"]) | (x["_coarse"] & (F.abs(acc["value"] - x["_value"]) < x["_width"]))
        changed = F.struct(x["_value"].alias("value"), x["_source"].alias("source"), F.concat(acc["revisions"], F.array(F.struct(x["_source"].alias("source"), acc["value"].alias("old"), x["_value"].alias("new")))).cast(entry).alias("revisions"))
        fresh = F.struct(x["_value"].alias("value"), x["_source"].alias("source"), acc["revisions"].alias("revisions"))
        return F.when(first, fresh).when(same, acc).otherwise(changed)

    cells = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(version)).alias("_versions"))
    state = cells.withColumn("_state", F.aggregate("_versions", start, step))
    return state.select(*keys, F.col("_state.value").alias("value"), F.col("_state.source").alias("source"), F.size("_state.revisions").alias("n_revisions"), F.col("_state.revisions").alias("revisions"))


def ingest(documents: DataFrame, keys: Sequence[str], order: Sequence[str], id_: str, error: Column) -> DataFrame:
    """Documents, the first of each id, with their status: failed (an error), superseded (a later good one of its keys) or ingested.

    The order must be total; documents that come again, in any order, change nothing.
    """
    from sorrel.operators.relational import first_per_key, version_chain

    once = first_per_key(documents.withColumn("_error", error), [id_], [*order])
    chain = version_chain(once, keys, order, id_, F.col("_error").isNull())
    status = F.when(F.col("_error").isNotNull(), "failed").when(F.col("superseded_by").isNotNull(), "superseded").otherwise("ingested")
    return chain.withColumn("status", status).withColumnRenamed("_error", "error")
