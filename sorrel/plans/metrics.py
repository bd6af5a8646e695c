"""Aggregations and metrics: latest periods, margins, shares, counts, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.operators.relational import latest_per_key
from sorrel.plans.registry import query
from sorrel.sources.tables import table


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """Per customer and year: sales of all orders and profit, here the finished orders less the open ones."""
    o = table(spark, d, "orders")
    profit = F.when(F.col("o_orderstatus") == "F", money("o_totalprice")).when(F.col("o_orderstatus") == "O", -money("o_totalprice")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(F.sum(money("o_totalprice")).cast("decimal(24,2)").alias("sales"), F.sum(profit).cast("decimal(24,2)").alias("profit"), F.count("*").alias("n_orders"))


_YEARLY = """yearly AS (SELECT o_custkey, year(o_orderdate) AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(24,2)) AS sales,
  CAST(sum(CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 'O' THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(24,2)) AS profit,
  count(*) AS n_orders FROM orders GROUP BY 1, 2)"""
_MARGIN = "CASE WHEN sales > 0 THEN CAST(CASE WHEN profit < 0 THEN -1 ELSE 1 END * floor((2 * abs(CAST(profit AS DECIMAL(30,2))) * 1000 + sales) / (2 * sales)) AS DOUBLE) / 10 + 0.0 END"


@query(f"""WITH {_YEARLY}, latest AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fy DESC) AS k, lag(sales) OVER (PARTITION BY o_custkey ORDER BY fy) AS before FROM yearly)
SELECT c_custkey, c_name, c_mktsegment, CAST(fy AS BIGINT) AS fy, CAST(sales AS DOUBLE) AS sales, {_MARGIN} AS margin,
  CASE WHEN before <> 0 THEN CAST(round(CAST(sales - before AS DECIMAL(30,6)) * 100 / abs(before), 1) AS DOUBLE) END AS yoy, CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders
FROM customer LEFT JOIN (SELECT * FROM latest WHERE k = 1) ON c_custkey = o_custkey""")
def company_rows(spark: SparkSession, d: str) -> DataFrame:
    """AGG22: one row a company with its latest year's sales, margin and change; absent years give nulls."""
    from pyspark.sql import Window

    years = yearly(spark, d).withColumn("before", F.lag("sales").over(Window.partitionBy("o_custkey").orderBy("fy")))
    latest = latest_per_key(years, ["o_custkey"], "fy")
    rows = table(spark, d, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "c_name", "c_mktsegment", F.col("fy").cast("bigint").alias("fy"), F.col("sales").cast("double").alias("sales"), S.ratio_percent(F.col("profit"), F.col("sales")).alias("margin"), S.change_percent(F.col("sales"), F.col("before")).alias("yoy"), F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1")
def latest_annual(spark: SparkSession, d: str) -> DataFrame:
    """AGG01, FLT13: the latest row of one kind for each key; the first wins a tie."""
    return latest_per_key(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_period(spark: SparkSession, d: str) -> DataFrame:
    """AGG02: arg-max over all rows of a key, in one partial aggregation."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(f"WITH {_YEARLY} SELECT o_custkey, CAST(fy AS BIGINT) AS fy, {_MARGIN} AS margin FROM yearly")
def operating_margin(spark: SparkSession, d: str) -> DataFrame:
    """AGG03, MTH04: margin in percent with one decimal, halves away from zero, null without positive sales."""
    return yearly(spark, d).select("o_custkey", F.col("fy").cast("bigint").alias("fy"), S.ratio_percent(F.col("profit"), F.col("sales")).alias("margin"))


@query("""SELECT c_custkey, CAST(CASE WHEN v < 0 THEN -1 ELSE 1 END * floor((2 * abs(v) + 100) / 200) AS BIGINT) AS hundreds
FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer)""")
def average_salary(spark: SparkSession, d: str) -> DataFrame:
    """AGG04: an amount in a larger unit, rounded half away from zero to an integer."""
    v = money("c_acctbal")
    size = S.round_half_up(F.abs(v), F.lit(100).cast("decimal(18,2)"))
    return table(spark, d, "customer").select("c_custkey", F.when(v < 0, -size).otherwise(size).cast("bigint").alias("hundreds"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-18' GROUP BY 1")
def week_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG05: counts by category since the Monday of a given day, 2024-01-17."""
    today = F.lit("2024-01-17").cast("date")
    e = table(spark, d, "events")
    return e.where((F.col("ts") >= F.date_trunc("week", today).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(today, 1).cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS month, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
  CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS own FROM events GROUP BY 1""")
def month_usage(spark: SparkSession, d: str) -> DataFrame:
    """AGG06, ADD25: spend by month in local time (UTC+9), in total and of one agent."""
    e = table(spark, d, "events").withColumn("month", F.date_format(F.col("ts") + F.expr("interval 9 hours"), "yyyy-MM"))
    return e.groupBy("month").agg(F.sum(money("value")).cast("double").alias("total"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", money("value"))), F.lit(0)).cast("double").alias("own"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS opened, count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1""")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG07, AGG11: counts by kind, one column for each."""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "finished"), ("O", "opened"), ("P", "partial"))))


@query("SELECT lang, source, CAST(sum(length(text)) AS BIGINT) AS chars, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1, 2")
def describe_elements(spark: SparkSession, d: str) -> DataFrame:
    """AGG08: total text length and first row by group."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.sum(F.length("text")).cast("bigint").alias("chars"), F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents")
def outline(spark: SparkSession, d: str) -> DataFrame:
    """AGG09: an outline row for each text."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"))


@query("""SELECT coalesce(lang, 'total') AS lang, count(*) AS n, CAST(sum(toxic) AS DOUBLE) / count(*) AS detected, CAST(sum(CASE WHEN quality = 0 THEN toxic END) AS DOUBLE) / nullif(count(*) FILTER (quality = 0), 0) AS detected_low
FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def detection_rates(spark: SparkSession, d: str) -> DataFrame:
    """AGG10: rates by group and in total; a rate over no rows is null."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    low = F.col("quality") == 0
    return rows.rollup("lang").agg(F.count("*").alias("n"), (F.sum("toxic").cast("double") / F.count("*")).alias("detected"), F.try_divide(F.sum(F.when(low, F.col("toxic"))).cast("double"), F.count_if(low)).alias("detected_low")).withColumn("lang", F.coalesce("lang", F.lit("total")))


@query("""SELECT r_name, CAST(sum(n) AS BIGINT) AS nations, CAST(max(customers) AS BIGINT) AS most_customers FROM (SELECT r_name, n_nationkey, 1 AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers
FROM region JOIN nation ON n_regionkey = r_regionkey) GROUP BY 1""")
def nested_count(spark: SparkSession, d: str) -> DataFrame:
    """AGG12, AGG13: sizes of nested lists summed, and their maximum, 0 without any."""
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    nations = table(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    lists = nations.groupBy("n_regionkey").agg(F.collect_list(F.coalesce("k", F.lit(0))).alias("sizes"))
    joined = table(spark, d, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select("r_name", F.size("sizes").cast("bigint").alias("nations"), F.coalesce(F.array_max("sizes"), F.lit(0)).cast("bigint").alias("most_customers"))


@query("""SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'all' WHEN bool_or(o_orderstatus = 'F') THEN 'some' ELSE 'none' END AS scope, strftime(min(o_orderdate), '%Y-%m') || '..' || strftime(max(o_orderdate), '%Y-%m') AS period FROM orders GROUP BY 1""")
def employee_scope(spark: SparkSession, d: str) -> DataFrame:
    """AGG14, AGG18: do all, some or no rows qualify; first to last period."""
    done = F.col("o_orderstatus") == "F"
    month = lambda c: F.date_format(c, "yyyy-MM")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.bool_and(done), "all").when(F.bool_or(done), "some").otherwise("none").alias("scope"), F.concat(month(F.min("o_orderdate")), F.lit(".."), month(F.max("o_orderdate"))).alias("period"))


@query("SELECT word, count(*) AS n, count(*) FILTER (p_size > 25) AS large FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_size FROM part) GROUP BY 1")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG15, AGG16: counts by each value of a list column."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_size")
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("""SELECT o_orderkey, CAST(total AS DOUBLE) AS total, CAST(parts AS DOUBLE) AS parts FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) FROM lineitem WHERE l_orderkey = o_orderkey) AS parts FROM orders)
WHERE parts IS NOT NULL AND total > 0 AND abs(parts - total) * 100 > 5 * total""")
def segment_gap(spark: SparkSession, d: str) -> DataFrame:
    """AGG19: totals that differ by over 5 % from the sum of their parts."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("parts"))
    rows = table(spark, d, "orders").select("o_orderkey", money("o_totalprice").alias("total")).join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where("total > 0 and abs(parts - total) * 100 > 5 * total").select("o_orderkey", F.col("total").cast("double").alias("total"), F.col("parts").cast("double").alias("parts"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""")
def ordered_kinds(spark: SparkSession, d: str) -> DataFrame:
    """AGG20: distinct kinds in the order in which they first stand."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


#: A glossary's names, a fixed small list.
GLOSSARY = ("small", "large", "green", "widget", "bolt", "blue", "red", "ring", "the", "and", "license", "data")


@query("WITH terms AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in GLOSSARY) + """]) AS word),
hits AS (SELECT doc_id, word, CAST((length(text) - length(replace(text, word, ''))) // length(word) AS BIGINT) AS n FROM (SELECT doc_id, lower(text) AS text FROM documents) CROSS JOIN terms)
SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM hits WHERE n > 0) WHERE k <= 5""")
def term_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG21: a text's five most frequent names of a glossary, within the text's own row."""
    low = F.col("low")
    found = F.filter(F.array(*(F.struct((-S.hits(low, F.lit(w))).alias("n"), F.lit(w).alias("word")) for w in GLOSSARY)), lambda h: h["n"] < 0)
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(F.slice(F.array_sort(found), 1, 5)).alias("h"))
    return rows.select("doc_id", F.col("h.word").alias("word"), (-F.col("h.n")).alias("n"))


@query("""SELECT p_brand, CAST(sum(CASE WHEN p_type = 'PROMO' THEN v ELSE 0 END) AS DOUBLE) AS promo, CAST(sum(CASE WHEN p_type IN ('SMALL', 'LARGE') THEN v ELSE 0 END) AS DOUBLE) AS sized,
  CAST(round(CAST(sum(CASE WHEN p_type = 'PROMO' THEN v ELSE 0 END) AS DECIMAL(30,6)) * 100 / nullif(sum(v), 0), 1) AS DOUBLE) AS share
FROM (SELECT p_brand, p_type, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'SMALL', 'LARGE')) GROUP BY 1""")
def segment_share(spark: SparkSession, d: str) -> DataFrame:
    """JON06: sales by class of segment and the share of one class among the mapped segments only."""
    classes = {"PROMO": "core", "SMALL": "sized", "LARGE": "sized"}  # a fixed mapping
    kind = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))[F.col("p_type")]
    parts = table(spark, d, "part").select("p_partkey", "p_brand", kind.alias("kind")).where("kind is not null")
    rows = table(spark, d, "lineitem").select("l_partkey", money("l_extendedprice").alias("v")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    core, sized = (F.sum(F.when(F.col("kind") == k, F.col("v")).otherwise(F.lit(0))) for k in ("core", "sized"))
    share = F.round(F.try_divide(core.cast("decimal(30,6)") * 100, F.sum("v")), 1)
    return rows.groupBy("p_brand").agg(core.cast("double").alias("promo"), sized.cast("double").alias("sized"), share.cast("double").alias("share"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS net, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Measures by two attributes, in one partial aggregation: the scan-heavy headline query."""
    net = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_quantity")).cast("double").alias("quantity"), F.sum(net).cast("double").alias("net"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, CAST(round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(30,6)) / 100, 1) AS DOUBLE) AS hundreds FROM orders GROUP BY 1")
def in_larger_unit(spark: SparkSession, d: str) -> DataFrame:
    """MTH05: sums in a unit a hundred times as large, with one decimal."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(S.in_hundreds(F.sum(money("o_totalprice"))).alias("hundreds"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(round(sum(CAST(value AS DECIMAL(18,2)) * CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 15 ELSE 1 END) / 1000000, 6) AS DOUBLE) AS cost FROM events GROUP BY 1""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """MTH14, ADD26: usage priced by kind, per million, rounded to six decimals."""
    price = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 15).otherwise(1)
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum(money("value") * price) / 1000000, 6).cast("double").alias("cost"))
