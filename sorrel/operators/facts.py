"""Typed rows from tagged facts: header, prioritised items, members, scaled amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.functions.scalars import scaled, strict_decimal


def header_values(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    """A row a document with a column for each name (element -> name); `stopped` says which is missing or has several values."""
    rows = facts.where(F.col("element").isin(*names)).groupBy("doc_id").pivot("element", list(names)).agg(F.collect_set("value"))
    found = facts.select("doc_id").distinct().join(rows, "doc_id", "left")
    bad = [F.when(F.coalesce(F.size(F.col(f"`{e}`")), F.lit(0)) != 1, F.lit(n)) for e, n in names.items()]
    return found.select("doc_id", *(F.when(F.size(F.col(f"`{e}`")) == 1, F.element_at(F.col(f"`{e}`"), 1)).alias(n) for e, n in names.items()), F.concat_ws(",", *bad).alias("stopped"))


def typed_items(facts: DataFrame, candidates: DataFrame, context: str) -> DataFrame:
    """doc_id, item, value (decimal, scaled by its unit), element, conflict of each item.

    candidates: a fixed small table (item, priority, element). The candidate of the lowest priority that has rows in the
    context counts, its first row gives the value, other values of it are a conflict. Units that aren't known give null.
    """
    rows = facts.where(F.col("context") == context).withColumn("number", strict_decimal(F.col("value"))).where("number is not null")
    met = rows.join(candidates, "element")
    low = F.min("priority").over(Window.partitionBy("doc_id", "item"))
    best = met.withColumn("_low", low).where("priority = _low")
    per = best.groupBy("doc_id", "item").agg(F.min_by(F.struct("number", "unit", "element"), "row_no").alias("f"), (F.min("number") != F.max("number")).alias("conflict"))
    return per.select("doc_id", "item", scaled(F.col("f.number").cast("decimal(24,6)"), F.col("f.unit")).alias("value"), F.col("f.element").alias("element"), "conflict")


def members(facts: DataFrame, context: str, elements: dict[str, str]) -> DataFrame:
    """doc_id and an array of (member, one value for each element's name), by member: contexts `{context}_{member}Member`."""
    member = F.regexp_extract("context", rf"^{context}_(\w+)Member$", 1)
    rows = facts.withColumn("member", member).where((F.col("member") != "") & F.col("element").isin(*elements)).withColumn("number", strict_decimal(F.col("value")))
    wide = rows.groupBy("doc_id", "member").agg(*(F.min_by(F.when(F.col("element") == e, F.col("number")), F.when((F.col("element") == e) & F.col("number").isNotNull(), F.col("row_no"))).alias(n) for e, n in elements.items()))
    return wide.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("member", *elements.values()))).alias("members"))


# Contexts of the current and the prior period by the header's kind of period.
CONTEXTS = {
    "FY": ("CurrentYearDuration", "CurrentYearInstant", "Prior1YearDuration", "Prior1YearInstant"),
    "HY": ("InterimDuration", "InterimInstant", "Prior1InterimDuration", "Prior1InterimInstant"),
    "Q2": ("CurrentYTDDuration", "CurrentQuarterInstant", "Prior1YTDDuration", "Prior1QuarterInstant"),
}
PLAIN_MEMBERS = ("ConsolidatedMember", "NonConsolidatedMember")


def contexts_for(kind: Column) -> Column:
    """A struct of the four contexts (duration, instant, prior_duration, prior_instant) of a kind of period; null for an unknown one."""
    names = ("duration", "instant", "prior_duration", "prior_instant")
    out = F.lit(None)
    for k, contexts in CONTEXTS.items():
        out = F.when(kind == k, F.struct(*(F.lit(c).alias(n) for n, c in zip(names, contexts, strict=True)))).otherwise(out)
    return out


def context_fits(context: Column, rule: str) -> Column:
    """total: no axis but consolidated or not; member: an axis; region: an axis with a region's name."""
    parts = F.filter(F.split(context, "_"), lambda p: p.endswith("Member"))
    if rule == "total":
        return F.forall(parts, lambda p: p.isin(*PLAIN_MEMBERS))
    member = F.contains(context, F.lit("Member"))
    return member if rule == "member" else member & context.rlike("(?i)地域|日本|北米|アジア|欧州|米国|中国|geograph|region|japan|northamerica|asia|europe|china|unitedstates|taiwan|korea")


def concept_candidates(facts: DataFrame, concepts: dict[str, tuple[list[str], list[str], str]]) -> DataFrame:
    """doc_id, concept, row_no, place of figures whose element or label holds one of a concept's parts in a context that fits; current ones first.

    concepts: a fixed small table: concept -> (parts of the element's name, parts of the label, rule of the context).
    """
    tests = []
    for name, (ids, labels, rule) in concepts.items():
        named = F.lit(False)
        for part in ids:
            named = named | F.contains(F.lower("element"), F.lit(part.lower()))
        for part in labels:
            named = named | F.contains("label", F.lit(part))
        tests.append(F.when(named & context_fits(F.col("context"), rule), F.lit(name)))
    met = facts.withColumn("concept", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    place = F.row_number().over(Window.partitionBy("doc_id", "concept").orderBy(~F.contains("context", F.lit("Current")), "row_no"))
    return met.select("doc_id", "concept", "row_no", place.alias("place"))


def extract(facts: DataFrame, header: dict[str, str], items: DataFrame, segments: tuple[str, str], staff: str, kind: str = "period_kind_raw") -> DataFrame:
    """One row a document: header values, items of the current and the prior period, staff, segments, anomalies.

    header: element -> name; items: a fixed small table (item, priority, element); segments: the element of a member's
    amount and the total that is no member; staff: the element of the number of staff. A header value that is missing or
    stands with several values stops the document; an item without a row is an anomaly `<item>_not_found`, one with
    several values `<item>_conflict`; prior values that aren't there are left out without a word.
    """
    head = header_values(facts, header)
    named = head.select("doc_id", contexts_for(F.col(kind)).alias("c"))
    rows = facts.join(named, "doc_id").withColumn("number", strict_decimal(F.col("value"))).where("number is not null")
    period = F.when(F.col("context") == F.col("c.duration"), "now").when(F.col("context") == F.col("c.prior_duration"), "prior")
    met = rows.withColumn("period", period).where("period is not null").join(items, "element")
    best = met.groupBy("doc_id", "item", "period", "priority").agg(F.min_by(F.struct("number", "unit"), "row_no").alias("f"), (F.min("number") != F.max("number")).alias("conflict"))
    first = best.groupBy("doc_id", "item", "period").agg(F.min_by(F.struct("f", "conflict"), "priority").alias("b"))
    value = scaled(F.col("b.f.number").cast("decimal(24,6)"), F.col("b.f.unit"))
    cells = first.select("doc_id", "item", "period", value.alias("value"), F.col("b.conflict").alias("conflict"))
    names = [r["item"] for r in items.select("item").distinct().orderBy("item").collect()]  # a fixed small table
    wide = cells.groupBy("doc_id").agg(*(F.max(F.when((F.col("item") == n) & (F.col("period") == p), F.col("value"))).alias(f"{p}_{n}") for n in names for p in ("now", "prior")), *(F.coalesce(F.bool_or((F.col("item") == n) & (F.col("period") == "now")), F.lit(False)).alias(f"has_{n}") for n in names), *(F.coalesce(F.bool_or((F.col("item") == n) & F.col("conflict") & (F.col("period") == "now")), F.lit(False)).alias(f"conflict_{n}") for n in names))
    people = rows.where((F.col("element") == staff) & (F.col("context") == F.col("c.instant"))).groupBy("doc_id").agg(F.min_by("number", "row_no").cast("bigint").alias("staff"))
    element, total = segments
    member = F.regexp_extract("context", r"^([A-Za-z0-9]+)_(?:\w+_)?([A-Za-z0-9]+)Member$", 2)
    own = rows.where((F.col("element") == element) & F.col("context").startswith(F.concat(F.col("c.duration"), F.lit("_")))).withColumn("member", member).where((F.col("member") != "") & ~F.col("member").isin(total, "NonConsolidated"))
    per = own.groupBy("doc_id", "member").agg(F.min_by("number", "row_no").alias("amount"), F.min("row_no").alias("at"))
    lists = per.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "member", "amount"))), lambda s: F.struct(s["member"].alias("member"), s["amount"].alias("amount"))).alias("segments"))
    out = head.join(wide, "doc_id", "left").join(people, "doc_id", "left").join(lists, "doc_id", "left")
    missing = [F.when(~F.coalesce(F.col(f"has_{n}"), F.lit(False)), f"{n}_not_found") for n in names] + [F.when(F.col("staff").isNull(), "staff_not_found")]
    conflicts = [F.when(F.col(f"conflict_{n}"), f"{n}_conflict") for n in names]
    return out.withColumn("anomalies", F.concat_ws(",", *missing, *conflicts)).drop(*(f"{k}_{n}" for k in ("has", "conflict") for n in names))


def single_code(facts: DataFrame, element: str) -> DataFrame:
    """doc_id and the document's code, null unless there is exactly one."""
    codes = facts.where(F.col("element") == element).groupBy("doc_id").agg(F.collect_set("value").alias("codes"))  # one in any sound document
    return facts.select("doc_id").distinct().join(codes, "doc_id", "left").select("doc_id", F.when(F.size("codes") == 1, F.element_at("codes", 1)).alias("code"))
