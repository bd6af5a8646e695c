"""Stored pointers to rows of a list that follow when rows are inserted, removed or put in another order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(rows: DataFrame, owner: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with their index (from 0) in their owner's list; the order should be total."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*owner).orderBy(*order)) - 1).cast("bigint"))  # one owner's list


def moved(pointers: DataFrame, pointer: str, section: str, before: DataFrame, after: DataFrame, owner: Sequence[str], key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """pointers with `/section/<index>/...` of the list before turned to the index that the same row (by key) has in the list after.

    Pointers to other sections, without an index, to a place that the list before doesn't have or to a row that is gone
    stay as they are. Of rows with the same key the first one counts. Two joins on owner and index or key; a list is one
    owner's, so no join key holds more than its pointers.
    """
    place = F.regexp_extract(pointer, rf"^/{section}/([0-9]+)(?:/|$)", 1)
    old = indexed(before, owner, order, "_old").select(*owner, *key, "_old")
    new = indexed(after, owner, order, "_place").groupBy(*owner, *key).agg(F.min("_place").alias("_new"))
    shift = old.join(new, [*owner, *key]).where("_old <> _new").select(*owner, "_old", "_new")
    rows = pointers.withColumn("_old", F.when(place != "", F.try_to_number(place, F.lit("9" * 18)).cast("bigint")))
    rest = F.regexp_replace(pointer, rf"^/{section}/[0-9]+", "")
    there = rows.join(shift, [*owner, "_old"], "left")
    return there.withColumn(pointer, F.when(F.col("_new").isNotNull(), F.concat(F.lit(f"/{section}/"), F.col("_new").cast("string"), rest)).otherwise(F.col(pointer))).select(*pointers.columns)
