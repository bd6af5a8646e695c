"""Periods and their restatement: the rows of later documents replace those of earlier ones, and so do their prior-year columns.

Truth follows the order of submission, so each period's events are folded in that order, whatever order they come in. A
period's events are the documents that report or restate it, a handful; they are folded inside Spark's expressions.

- An amount that differs by less than a unit's rounding keeps its older, more precise value.
- Before a period has a row of its own, prior-year columns say nothing.
- Segments are replaced as a set; a member that stays keeps its value if it hardly differs.
- A change of the accounting standard replaces the measures, and ordinary income goes if the new standard has none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = "array<struct<member: string, amount: decimal(18,2)>>"
REVISION = "struct<doc: bigint, path: string, old: decimal(18,2), new: decimal(18,2)>"


def _kept(old: Column, new: Column) -> Column:
    """The new amount, or the old one where they hardly differ."""
    return F.when(F.abs(old - new) < 1, old).otherwise(new)


def _segments(old: Column, new: Column) -> Column:
    def keep(s: Column) -> Column:
        before = F.filter(old, lambda o: o["member"] == s["member"])
        return F.struct(s["member"].alias("member"), F.when(F.size(before) > 0, _kept(F.get(before, 0)["amount"], s["amount"])).otherwise(s["amount"]).alias("amount"))

    return F.transform(new, keep).cast(SEGMENTS)


def _revision(doc: Column, path: Column, old: Column, new: Column) -> Column:
    return F.struct(doc.cast("bigint").alias("doc"), path.alias("path"), old.cast("decimal(18,2)").alias("old"), new.cast("decimal(18,2)").alias("new")).cast(REVISION)


def restated(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, sales, ordinary, standard, segments, source and revisions of each period that has a row of its own.

    events: keys, order, doc, own (is it the period's own document, or a later one's prior column), standard, sales,
    ordinary and segments (member, amount).
    """
    event = F.struct(*order, *(c for c in ("doc",) if c not in order), "own", "standard", F.col("sales").cast("decimal(18,2)").alias("sales"), F.col("ordinary").cast("decimal(18,2)").alias("ordinary"), F.col("segments").cast(SEGMENTS).alias("segments"))
    lists = events.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("_events"))
    first = F.array_position(F.transform("_events", lambda e: e["own"]), True)
    lists = lists.where(first > 0).withColumn("_events", F.slice("_events", F.greatest(first.cast("int"), F.lit(1)), F.size("_events")))

    def state(e: Column, revisions: Column) -> Column:
        return F.struct(e["sales"].alias("sales"), e["ordinary"].alias("ordinary"), e["standard"].alias("standard"), e["segments"].alias("segments"), e["doc"].alias("source"), revisions.alias("revisions"))

    def step(a: Column, e: Column) -> Column:
        switched = ~e["own"] & (a["standard"] != e["standard"])
        sales = _kept(a["sales"], e["sales"])
        gone = (switched | e["own"]) & (e["standard"] != "jgaap")
        ordinary = F.when(gone, F.lit(None)).when(e["ordinary"].isNull(), a["ordinary"]).when(a["ordinary"].isNull(), F.when(switched | e["own"], e["ordinary"])).otherwise(_kept(a["ordinary"], e["ordinary"])).cast("decimal(18,2)")
        segments = _segments(a["segments"], e["segments"])
        changes = [F.when(~old.eqNullSafe(new), _revision(e["doc"], F.lit(name), old, new)) for name, old, new in (("sales", a["sales"], sales), ("ordinary", a["ordinary"], ordinary))]
        moved = F.transform(F.filter(segments, lambda s: F.exists(a["segments"], lambda o: (o["member"] == s["member"]) & (o["amount"] != s["amount"]))), lambda s: _revision(e["doc"], F.concat(F.lit("segments/"), s["member"]), F.get(F.filter(a["segments"], lambda o: o["member"] == s["member"]), 0)["amount"], s["amount"]))
        log = F.concat(a["revisions"], F.filter(F.array(*changes), lambda r: r.isNotNull()), moved).cast(f"array<{REVISION}>")
        source = F.when(e["own"] | switched, e["doc"]).otherwise(a["source"])
        return F.struct(sales.cast("decimal(18,2)").alias("sales"), ordinary.alias("ordinary"), F.when(e["own"] | switched, e["standard"]).otherwise(a["standard"]).alias("standard"), segments.alias("segments"), source.alias("source"), log.alias("revisions"))

    start = state(F.element_at("_events", 1), F.array().cast(f"array<{REVISION}>"))
    done = F.aggregate(F.slice("_events", 2, F.greatest(F.size("_events") - 1, F.lit(0))), start, step)
    return lists.select(*keys, done.alias("s")).select(*keys, "s.*")


CELL = "struct<at: {at}, doc: bigint, supersedes: bigint, old: {value}, new: {value}>"


def restated_cells(events: DataFrame, keys: Sequence[str], at: str, tolerance: Column | float = 0) -> DataFrame:
    """keys, value, source and revisions (at, doc, supersedes, old, new) of cells, each with the document that its value is from.

    events: keys, at, doc, own (does the document report the cell's own period, or its prior column) and value. A cell
    begins with the first document of its own period; what came before says nothing. One that reports the period again
    gives the cell its value, or none; a prior column replaces a value that is there by one that it has. Values that
    differ by less than tolerance are the same, and the older one stays with its source. A revision names the document
    whose value it supersedes. Documents count by at and doc; a cell's are a handful.
    """
    kinds = dict(events.dtypes)
    value, when = kinds["value"], kinds[at]
    cell = CELL.format(at=when, value=value)
    lists = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col("doc").cast("bigint").alias("doc"), "own", "value"))).alias("_events"), F.max(F.lit(tolerance) if not isinstance(tolerance, Column) else tolerance).alias("_tolerance"))
    first = F.array_position(F.transform("_events", lambda e: e["own"]), True).cast("int")
    lists = lists.withColumn("_first", first).where("_first > 0")
    begin = F.get("_events", F.col("_first") - 1)
    start = F.struct(begin["value"].alias("value"), begin["doc"].alias("source"), F.array().cast(f"array<{cell}>").alias("revisions"))

    def step(a: Column, e: Column) -> Column:
        differ = ~a["value"].eqNullSafe(e["value"]) & F.coalesce(F.abs(a["value"] - e["value"]) >= F.col("_tolerance"), F.lit(True))
        there = e["own"] | (a["value"].isNotNull() & e["value"].isNotNull())
        line = F.struct(e["at"].alias("at"), e["doc"].alias("doc"), a["source"].alias("supersedes"), a["value"].alias("old"), e["value"].alias("new")).cast(cell)
        change = differ & there
        equal = e["own"] & a["value"].eqNullSafe(e["value"])
        return F.struct(F.when(change, e["value"]).otherwise(a["value"]).cast(value).alias("value"), F.when(change | equal, e["doc"]).otherwise(a["source"]).alias("source"), F.when(change, F.array_append(a["revisions"], line)).otherwise(a["revisions"]).alias("revisions"))

    later = F.slice("_events", F.greatest("_first", F.lit(0)) + 1, F.size("_events"))
    return lists.select(*keys, F.aggregate(later, start, step).alias("s")).select(*keys, "s.*")


def member_changes(events: DataFrame, keys: Sequence[str], at: str, members: str) -> DataFrame:
    """keys, at, doc, added and removed (sorted) of each document after which a period's members aren't those before.

    events as in `restated_cells`, with an array of member names in place of the value; members are replaced as a set.
    """
    by = Window.partitionBy(*keys).orderBy(at, "doc")  # a period's documents, a handful
    begun = F.max(F.col("own").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = events.withColumn("_begun", begun).where("_begun").withColumn("_before", F.lag(members).over(by)).where("_before IS NOT NULL")
    new = rows.select(*keys, at, "doc", F.sort_array(F.array_except(members, "_before")).alias("added"), F.sort_array(F.array_except("_before", members)).alias("removed"))
    return new.where("size(added) > 0 OR size(removed) > 0")
