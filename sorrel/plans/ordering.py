"""Pointers that follow insertions, lists by a language's order, candidates in three lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.functions import collation as C
from sorrel.operators import pointers
from sorrel.plans.registry import query
from sorrel.sources.tables import table


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS after FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY after) - 1 AS before FROM o WHERE o_orderstatus <> 'P')
SELECT o_custkey, o_orderkey, '/financials/' || CAST(before AS VARCHAR) || '/net_sales/value' AS stored, '/financials/' || CAST(after AS VARCHAR) || '/net_sales/value' AS pointer FROM b""")
def moved_pointers(spark: SparkSession, d: str) -> DataFrame:
    """WIN09, INC16: pointers that were stored before a customer's open orders were inserted into its list, and where they point to after it."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    before, order = o.where("o_orderstatus <> 'P'"), ["o_orderdate", "o_orderkey"]
    stored = pointers.indexed(before, ["o_custkey"], order, "place").select("o_custkey", "o_orderkey", F.concat(F.lit("/financials/"), F.col("place").cast("string"), F.lit("/net_sales/value")).alias("stored"))
    return pointers.moved(stored.withColumn("pointer", F.col("stored")), "pointer", "financials", before, o, ["o_custkey"], ["o_orderkey"], order).select("o_custkey", "o_orderkey", "stored", "pointer")


#: Segments by names in kanji, kana and Latin letters; one has none.
_NAMES = {"BUILDING": "建設", "AUTOMOBILE": "じどうしゃ", "MACHINERY": "キカイ", "HOUSEHOLD": "Household", "FURNITURE": ""}
_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey, nullif({_CASE}, '') AS label, c_acctbal FROM customer)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY label COLLATE ja ASC NULLS LAST, c_custkey) AS BIGINT) AS rising, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY label COLLATE ja DESC NULLS LAST, c_custkey) AS BIGINT) AS falling FROM c""")
def collated_places(spark: SparkSession, d: str) -> DataFrame:
    """SRT03, JON07: places by names in the order of the language, in both directions, blank ones last in either."""
    c = table(spark, d, "customer")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv)), F.col("c_mktsegment"))
    rows = c.select("c_custkey", "c_nationkey", label.alias("label"))
    place = lambda falling: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*C.blanks_last(F.col("label"), falling, "ja"), "c_custkey")).cast("bigint")
    return rows.select("c_custkey", place(False).alias("rising"), place(True).alias("falling"))


@query(f"""WITH c AS (SELECT c_nationkey, {_CASE} || c_name AS name FROM customer), h AS (SELECT c_nationkey, name, CASE WHEN name LIKE 'じ%' THEN 'さ行' WHEN name LIKE 'キ%' THEN 'か行' WHEN name LIKE '建%' THEN 'その他' ELSE substr(name, 1, 1) END AS heading FROM c)
SELECT c_nationkey, heading, count(*) AS n, arg_min(name, struct_pack(p := place, n := name)) AS first_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY min(o), heading) AS BIGINT) AS place
FROM (SELECT *, CASE heading WHEN 'か行' THEN 1 WHEN 'さ行' THEN 2 WHEN 'その他' THEN 99 ELSE 10 END AS o, row_number() OVER (PARTITION BY c_nationkey, heading ORDER BY name COLLATE ja, name) AS place FROM h) GROUP BY 1, 2""")
def reading_groups(spark: SparkSession, d: str) -> DataFrame:
    """SRT06, SRT07, STR33, ADD15: names under the rows of the kana, letters and the rest in their fixed order, with their number and the first by the language."""
    c = table(spark, d, "customer")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv)), F.col("c_mktsegment"))
    rows = c.select("c_nationkey", F.concat(label, F.col("c_name")).alias("name")).withColumn("heading", C.reading_heading(F.col("name")))
    by = rows.groupBy("c_nationkey", "heading").agg(F.count("*").alias("n"), F.min(F.struct(C.collated(F.col("name")).alias("k"), F.col("name").alias("name"))).alias("x"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(C.heading_place(F.col("heading")), "heading")).cast("bigint")  # one nation's headings
    return by.select("c_nationkey", "heading", "n", F.col("x.name").alias("first_name"), place.alias("place"))


@query("""WITH e AS (SELECT event_id, event_type, value, ts, CAST(date_trunc('week', ts) AS DATE) AS week FROM events), n AS (SELECT week, event_type, count(*) AS had FROM e GROUP BY 1, 2),
r AS (SELECT e.*, coalesce(had, 0) >= 450 AS filled FROM e LEFT JOIN n ON n.week = e.week - 7 AND n.event_type = e.event_type)
SELECT strftime(week, '%Y-%m-%d') AS week, 'regular' AS list, event_id, CAST(row_number() OVER (PARTITION BY week ORDER BY filled, event_type <> 'purchase', value DESC, CAST(ts AS DATE) DESC, event_id) AS BIGINT) AS place FROM r WHERE event_type NOT IN ('view', 'error')
UNION ALL SELECT strftime(week, '%Y-%m-%d'), 'observed', event_id, CAST(row_number() OVER (PARTITION BY week ORDER BY value DESC, event_id) AS BIGINT) FROM r WHERE event_type = 'error'
UNION ALL SELECT strftime(week, '%Y-%m-%d'), 'excluded', NULL, CAST(count(*) AS BIGINT) FROM r WHERE event_type = 'view' GROUP BY week""")
def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    """WIN06: a week's candidates in three lists: regular ones ranked, kinds that filled their cap the week before last; observed ones (errors) by score alone; the number of those excluded (views)."""
    from sorrel.operators import relational as R

    e = table(spark, d, "events").select("event_id", "event_type", "value", "ts", F.date_trunc("week", "ts").cast("date").alias("week"))
    had = e.groupBy(F.date_add("week", 7).alias("week"), "event_type").agg((F.count("*") >= 450).alias("full"))
    rows = e.join(had, ["week", "event_type"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    regular = rows.where("event_type NOT IN ('view', 'error')").withColumn("later", F.col("event_type") != "purchase")
    first = R.places(regular, ["week"], [F.col("full"), F.col("later"), F.desc("value"), F.to_date("ts").desc(), F.col("event_id")])
    seen = R.places(rows.where("event_type = 'error'"), ["week"], [F.desc("value"), F.col("event_id")])
    out = lambda df, name: df.select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.lit(name).alias("list"), "event_id", "place")
    left = rows.where("event_type = 'view'").groupBy("week").agg(F.count("*").alias("place")).withColumn("event_id", F.lit(None).cast("bigint"))
    return out(first, "regular").unionByName(out(seen, "observed")).unionByName(out(left, "excluded"))


_VERSIONS = """o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, year(o_orderdate) AS fy, min(o_orderkey) OVER (PARTITION BY o_custkey) AS parent FROM orders),
v AS (SELECT *, last_value(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey, fy ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM o),
s AS (SELECT *, coalesce(previous, CASE WHEN parent <> o_orderkey THEN parent END) AS supersedes FROM v)"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of a customer's year; the listing's parent is the customer's order with the smallest key."""
    from sorrel.operators import relational as R

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", F.year("o_orderdate").alias("fy"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("parent"))
    chain = R.version_chain(o, ["o_custkey", "fy"], ["o_orderdate", "o_orderkey"], "o_orderkey", F.col("o_orderstatus") != "P").withColumnRenamed("supersedes", "previous")
    return R.superseded_by_parent(chain.join(first, "o_custkey"), "o_orderkey", "previous", "parent")


@query(f"WITH {_VERSIONS} SELECT o_orderkey, supersedes FROM s")
def superseded_parents(spark: SparkSession, d: str) -> DataFrame:
    """INC15: what a version supersedes: the usable one before it in its year, or else the parent that the listing names."""
    return _versions(spark, d).select("o_orderkey", "supersedes")


@query(f"WITH {_VERSIONS} SELECT o_orderkey, 'nothing supersedes it' AS rule FROM s WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT supersedes FROM s WHERE supersedes IS NOT NULL)")
def unpointed_versions(spark: SparkSession, d: str) -> DataFrame:
    """JON16: versions that are marked as replaced (here those of status F) must be superseded by one, and what is superseded must be there."""
    from sorrel.operators import relational as R

    return R.unpointed(_versions(spark, d), "o_orderkey", F.col("o_orderstatus") == "F", "supersedes")
