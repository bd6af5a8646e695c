"""Relational building blocks: latest rows, candidates, earlier periods, upserts, snapshots, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], by: str, *ties: Column | str) -> DataFrame:
    """The row with the largest `by` of each key; of equal ones the first by ties. Nulls of `by` come last."""
    return first_per_key(df, keys, [F.col(by).desc_nulls_last(), *ties])


def first_candidate(rows: DataFrame, candidates: DataFrame, match: Column, keys: Sequence[str], priority: str, order: Order) -> DataFrame:
    """Rows joined with a small table of candidates; of each key the candidate of lowest priority, then the first row.

    `conflict` tells whether the winning candidate matched rows with different values of the column `value`. Both steps
    are partial aggregates, so a key that holds most rows is no more work than another.
    """
    met = rows.join(candidates, match)
    names = [c for c in met.columns if c not in keys]
    per = met.groupBy(*keys, priority).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"), (F.min("value") != F.max("value")).alias("conflict"))
    best = per.groupBy(*keys).agg(F.min_by(F.struct("_row", "conflict"), priority).alias("_best"))
    return best.select(*keys, "_best._row.*", "_best.conflict")


def places(df: DataFrame, keys: Sequence[str], order: Order, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) within its keys, for keys that are few or hold many rows.

    Rows are dealt into ranges of keys and order, so a key may span many tasks; a place is the rows of the key in the
    ranges before plus the place in the own range. The order must be total.
    """
    from sorrel.session import kept

    by = [*(F.col(k) for k in keys), *order]
    dealt = kept(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).drop("_n")  # a row a range
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    null_safe = [dealt["_range"] == before["_range"], *(dealt[k].eqNullSafe(before[k]) for k in keys)]
    placed = dealt.withColumn("_own", own)
    condition = null_safe[0]
    for c in null_safe[1:]:
        condition = condition & c
    joined = placed.join(before, condition)
    return joined.select(*(placed[c] for c in df.columns), (F.col("_before") + F.col("_own")).cast("bigint").alias(name))


def earlier_period(df: DataFrame, keys: Sequence[str], day: str, least: int, most: int, same: str, order: str) -> DataFrame:
    """Each row with the row of its key that is least to most days older, as struct `previous`.

    A row with the same value of `same` goes before others, then the last by `order`. Days are dealt into bins as wide
    as the range, so the join is an equi-join on key and bin with a residual condition.
    """
    width = most
    bin_of = F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / F.lit(width))
    left = df.withColumn("_row", F.struct(*df.columns)).withColumn("_bin", F.explode(F.array(bin_of, bin_of - 1, bin_of - 2)))
    right = df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*df.columns).alias("previous"), bin_of.alias("_right"))
    gap = F.datediff(F.col(day), F.col(f"previous.{day}"))
    on = [left[k] == right[f"_{k}"] for k in keys] + [left["_bin"] == right["_right"]]
    met = left.join(right, on, "inner").where(gap.between(least, most))
    best = met.withColumn("_best", F.row_number().over(Window.partitionBy("_row").orderBy((F.col(f"previous.{same}") == F.col(same)).desc(), F.col(f"previous.{order}").desc()))).where("_best = 1")
    return best.select(*df.columns, "previous")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new, and those of base whose key isn't in new; `change` says kept, replaced or added."""
    old_keys = base.select(*keys).distinct().withColumn("_old", F.lit(True))
    kept = base.join(new.select(*keys).distinct(), list(keys), "left_anti").withColumn("change", F.lit("kept"))
    added = new.join(old_keys, list(keys), "left").withColumn("change", F.when(F.col("_old"), "replaced").otherwise("added")).drop("_old")
    return kept.unionByName(added)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Key, `change` (added, removed or changed) and old and new values of rows that differ, null-safely."""
    old = before.select(*keys, F.struct(*values).alias("_old"))
    new = after.select(*keys, F.struct(*values).alias("_new"))
    both = old.join(new, list(keys), "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    flat = [c for v in values for c in (F.col(f"_old.{v}").alias(f"old_{v}"), F.col(f"_new.{v}").alias(f"new_{v}"))]
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", *flat)


def version_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], id_: str, usable: Column) -> DataFrame:
    """Each version's `supersedes` (the usable one before it) and `superseded_by` (the usable one after it)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    own = F.when(usable, F.col(id_))
    before = F.last(own, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(own, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("supersedes", before).withColumn("superseded_by", F.when(usable, after))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """Problems of rows whose reference is missing: rule and key."""
    missing = child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return missing.where(F.col(child_key).isNotNull()).select(F.lit(rule).alias("rule"), F.col(child_key).cast("string").alias("key"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Problems of keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key"))


def first_seen(df: DataFrame, key: str, order: Order, seen: DataFrame | None = None) -> DataFrame:
    """One row a key, the first in the order, without keys that are in seen."""
    rows = df if seen is None else df.join(seen.select(key).distinct(), key, "left_anti")
    return first_per_key(rows, [key], order)


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers of each key: first and last."""
    distinct = df.select(*keys, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return distinct.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], id_: str) -> DataFrame:
    """Previous and next id within the key's order, and whether a row is the last."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(id_).over(by)).withColumn("next", F.lead(id_).over(by)).withColumn("is_last", F.lead(id_).over(by).isNull())


def greedy_pairs(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one assignment within each group: best score first, ties by left and right, each used once.

    A pair that is the best of both its sides is what taking the best pair first would take at some time, so all such
    pairs are taken at once, what they use goes, and so on: rounds of aggregates and joins, however large a group is.
    """
    from sorrel.session import kept

    rest = kept(pairs.where(F.col(score) >= least).select(group, left, right, score).distinct(), "pairs")
    chosen: DataFrame | None = None
    while not rest.isEmpty():
        rank = F.struct(F.col(score).alias("s"), (-F.col(left)).alias("l"), (-F.col(right)).alias("r"))
        best_left = rest.groupBy(group, left).agg(F.max_by(right, rank).alias("_right"))
        best_right = rest.groupBy(group, right).agg(F.max_by(left, rank).alias("_left"))
        taken = rest.join(best_left, [group, left]).join(best_right, [group, right]).where((F.col("_right") == F.col(right)) & (F.col("_left") == F.col(left)))
        taken = kept(taken.select(group, left, right, score), "taken")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        rest = kept(rest.join(taken.select(group, left), [group, left], "left_anti").join(taken.select(group, right), [group, right], "left_anti"), "pairs")
    return rest if chosen is None else chosen


def running_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, budget: float) -> DataFrame:
    """The rows of each key up to the first whose running sum exceeds the budget."""
    total = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", total).where(F.col("running") <= budget)


def superseded_by_parent(df: DataFrame, id_: str, previous: str, parent: str, form: str = "^[0-9]+$") -> DataFrame:
    """df with `supersedes`: the previous version, or else the parent that a listing names, if that is an id of the form and not the row's own."""
    named = F.col(parent).cast("string")
    fits = named.rlike(form) & (named != F.col(id_).cast("string"))
    return df.withColumn("supersedes", F.coalesce(F.col(previous), F.when(fits, F.col(parent))))


def unpointed(df: DataFrame, id_: str, replaced: Column, supersedes: str) -> DataFrame:
    """Rows that are marked as replaced though no row supersedes them, and rows that supersede one that isn't there: id, rule."""
    ids = df.select(F.col(id_).alias("_id")).distinct()
    pointed = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("_id"), F.col(id_).alias("_by"))
    lost = df.where(replaced).select(F.col(id_).alias("_id")).join(pointed.select("_id").distinct(), "_id", "left_anti").select(F.col("_id").alias(id_), F.lit("nothing supersedes it").alias("rule"))
    wrong = pointed.join(ids, "_id", "left_anti").select(F.col("_by").alias(id_), F.lit("what it supersedes isn't there").alias("rule"))
    return lost.unionByName(wrong)
