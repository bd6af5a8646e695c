"""Windows, rankings and sorts: changes between periods, version chains, running totals, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.operators import relational as R
from sorrel.plans.metrics import _YEARLY, money, yearly
from sorrel.plans.registry import query
from sorrel.sources.tables import table


@query(f"""WITH {_YEARLY} SELECT o_custkey, CAST(fy AS BIGINT) AS fy, CASE WHEN before <> 0 THEN CAST(round(CAST(sales - before AS DECIMAL(30,6)) * 100 / abs(before), 1) AS DOUBLE) END AS change
FROM (SELECT *, lag(sales) OVER (PARTITION BY o_custkey ORDER BY fy) AS before FROM yearly)""")
def yearly_change(spark: SparkSession, d: str) -> DataFrame:
    """WIN03, WIN04: change against the period before in percent; null for the first period and after zero."""
    before = F.lag("sales").over(Window.partitionBy("o_custkey").orderBy("fy"))
    return yearly(spark, d).withColumn("before", before).select("o_custkey", F.col("fy").cast("bigint").alias("fy"), S.change_percent(F.col("sales"), F.col("before")).alias("change"))


@query(f"""WITH {_YEARLY}, w AS (SELECT o_custkey, fy, n_orders, lag(profit) OVER p AS before, profit, string_agg(CAST(n_orders AS VARCHAR), ',') OVER (PARTITION BY o_custkey ORDER BY fy ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS spark FROM yearly WINDOW p AS (PARTITION BY o_custkey ORDER BY fy))
SELECT o_custkey, CAST(fy AS BIGINT) AS fy, CASE WHEN before > 0 THEN CAST(round(CAST(profit - before AS DECIMAL(30,6)) * 100 / before, 1) AS DOUBLE) END AS change, spark FROM w""")
def indicator_cards(spark: SparkSession, d: str) -> DataFrame:
    """WIN05: change that needs a positive period before, and the last six periods' values."""
    by = Window.partitionBy("o_custkey").orderBy("fy")
    last = F.array_join(F.transform(F.collect_list("n_orders").over(by.rowsBetween(-5, 0)), lambda n: n.cast("string")), ",")
    rows = yearly(spark, d).select("o_custkey", "fy", "profit", F.lag("profit").over(by).alias("before"), last.alias("spark"))
    return rows.select("o_custkey", F.col("fy").cast("bigint").alias("fy"), F.when(F.col("before") > 0, S.change_percent(F.col("profit"), F.col("before"))).alias("change"), "spark")


@query("""WITH e AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM events WHERE event_type <> 'view'), c AS (SELECT *, row_number() OVER (PARTITION BY week, event_type ORDER BY value DESC, event_id) > 10 AS capped FROM e)
SELECT strftime(week, '%Y-%m-%d') AS week, event_id, place FROM (SELECT week, event_id, CAST(row_number() OVER (PARTITION BY week ORDER BY CASE WHEN capped THEN 1 ELSE 0 END, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, value DESC, ts DESC, event_id) AS BIGINT) AS place FROM c) WHERE place <= 30""")
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """WIN06: a week's top 30; kinds over their cap come last, then priority, score, newness, id."""
    e = table(spark, d, "events").where("event_type <> 'view'").withColumn("week", F.date_trunc("week", "ts").cast("date"))
    capped = F.row_number().over(Window.partitionBy("week", "event_type").orderBy(F.desc("value"), "event_id")) > 10
    order = [F.when(F.col("capped"), 1).otherwise(0), F.when(F.col("event_type") == "error", 0).otherwise(1), F.desc("value"), F.desc("ts"), "event_id"]
    place = F.row_number().over(Window.partitionBy("week").orderBy(*order)).cast("bigint")
    return e.withColumn("capped", capped).withColumn("place", place).where("place <= 30").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_id", "place")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus <> 'P' AS usable FROM orders), w AS (SELECT *,
  max(CASE WHEN usable THEN struct_pack(d := o_orderdate, k := o_orderkey) END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  min(CASE WHEN usable THEN struct_pack(d := o_orderdate, k := o_orderkey) END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM o)
SELECT o_orderkey, b.k AS supersedes, CASE WHEN usable THEN a.k END AS superseded_by, CASE WHEN NOT usable THEN 'failed' WHEN a IS NULL THEN 'ingested' ELSE 'superseded' END AS status FROM w""")
def filing_versions(spark: SparkSession, d: str) -> DataFrame:
    """WIN01, WIN02, INC14, INC15: what each version replaces and is replaced by; failed ones replace nothing."""
    usable = F.col("o_orderstatus") != "P"
    chain = R.version_chain(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", usable)
    status = F.when(~usable, "failed").when(F.col("superseded_by").isNull(), "ingested").otherwise("superseded")
    return chain.select("o_orderkey", "supersedes", "superseded_by", status.alias("status"))


@query("""SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, lead(turn) OVER w IS NULL AS is_last, coalesce(lead(role) OVER w <> role, false) AS crosses FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def turn_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """WIN07: each turn with the one before and after it, whether it is the last, whether the role changes next."""
    rows = R.neighbours(table(spark, d, "conversations"), ["conv_id"], ["turn"], "turn")
    crosses = F.coalesce(F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")) != F.col("role"), F.lit(False))
    return rows.select("conv_id", "turn", "previous", "next", "is_last", crosses.alias("crosses"))


@query("SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS place FROM part")
def rank_in_stage(spark: SparkSession, d: str) -> DataFrame:
    """WIN08: place within the group."""
    return R.places(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], ["p_size", "p_partkey"]).select("p_partkey", "p_brand", "place")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before > o_totalprice""")
def falling_rows(spark: SparkSession, d: str) -> DataFrame:
    """WIN10: rows below the one before them, where the order should rise."""
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", before.alias("before")).where("before > o_totalprice").select("o_orderkey")


@query("""WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2)
SELECT day, event_type, CAST(v AS DOUBLE) AS v, CAST(sum(v) OVER (PARTITION BY day ORDER BY event_type) - v AS DOUBLE) AS start, CAST(sum(v) OVER (PARTITION BY day) AS DOUBLE) AS total FROM t""")
def stacked_series(spark: SparkSession, d: str) -> DataFrame:
    """WIN11, ADD06: where each part of a stack starts, and the stack's total."""
    t = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.sum(money("value")).alias("v"))
    start = F.sum("v").over(Window.partitionBy("day").orderBy("event_type")) - F.col("v")
    return t.select("day", "event_type", F.col("v").cast("double").alias("v"), start.cast("double").alias("start"), F.sum("v").over(Window.partitionBy("day")).cast("double").alias("total"))


@query("""SELECT event_id, CAST(running AS DOUBLE) AS running FROM (SELECT event_id, sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events) WHERE running <= 2500""")
def admitted_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """ADD47: rows up to the one at which the running sum of their key leaves the budget; refused calls that cost nothing are in `admitted_calls`."""
    e = table(spark, d, "events").withColumn("amount", money("value"))
    return R.running_budget(e, ["user_id"], ["ts", "event_id"], "amount", 2500).select("event_id", F.col("running").cast("double").alias("running"))


@query("""WITH c AS (SELECT p_retailprice, p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20) SELECT 'c' || lpad(CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC) AS VARCHAR), 2, '0') AS id, p_partkey FROM c""")
def numbered_top(spark: SparkSession, d: str) -> DataFrame:
    """SRT02: the top 20, numbered c01, c02 and so on; only those 20 rows are numbered."""
    order = [F.desc("p_retailprice"), F.desc("p_partkey")]
    top = table(spark, d, "part").orderBy(*order).limit(20)
    return top.select(F.format_string("c%02d", F.row_number().over(Window.orderBy(*order))).alias("id"), "p_partkey")


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC NULLS LAST, c_custkey) AS BIGINT) AS falling, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY v NULLS LAST, c_custkey) AS BIGINT) AS rising FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer)""")
def blanks_last(spark: SparkSession, d: str) -> DataFrame:
    """SRT03, SRT09: places in either direction, blanks last in both."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    falling = R.places(rows, ["c_nationkey"], [F.col("v").desc_nulls_last(), "c_custkey"], "falling")
    return R.places(falling, ["c_nationkey"], [F.col("v").asc_nulls_last(), "c_custkey"], "rising").select("c_custkey", "falling", "rising")


@query("""WITH l AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT o_custkey, k AS o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS lines FROM l JOIN lineitem ON l_orderkey = k GROUP BY 1, 2""")
def latest_regions(spark: SparkSession, d: str) -> DataFrame:
    """SRT04: the latest row that has parts, with its parts by falling value."""
    li = table(spark, d, "lineitem")
    known = li.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    best = table(spark, d, "orders").join(known, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    lines = li.join(best, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("v"), "l_linenumber", "l_partkey", "l_suppkey"))).alias("parts"))  # one order's lines
    return lines.select("o_custkey", "o_orderkey", F.array_join(F.transform("parts", lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


@query("""WITH t AS (SELECT p_partkey, p_name, p_type, string_split(lower(p_name), ' ') AS keys FROM part),
s AS (SELECT p_partkey, p_type, list_max(list_transform(keys, lambda k: CASE WHEN k = 'red' THEN 3 WHEN starts_with(k, 'red') THEN 2 WHEN contains(k, 'red') THEN 1 ELSE 0 END)) AS a, list_max(list_transform(keys, lambda k: CASE WHEN k = 'wid' THEN 3 WHEN starts_with(k, 'wid') THEN 2 WHEN contains(k, 'wid') THEN 1 ELSE 0 END)) AS b FROM t)
SELECT p_partkey, CAST(a + b AS BIGINT) AS score FROM s WHERE a > 0 AND b > 0 ORDER BY score DESC, p_type, p_partkey LIMIT 50""")
def search_parts(spark: SparkSession, d: str) -> DataFrame:
    """STR05, SRT05: the 50 best matches of a query; all its tokens must hit."""
    score = S.token_score(F.split(F.lower("p_name"), " "), F.array(F.lit("red"), F.lit("wid")))
    found = table(spark, d, "part").select("p_partkey", "p_type", score.cast("bigint").alias("score")).where("score >= 0")
    return found.orderBy(F.desc("score"), "p_type", "p_partkey").limit(50).select("p_partkey", "score")


@query("""SELECT p_type, CAST(first AS BIGINT) AS first, CAST(row_number() OVER (ORDER BY first, p_type) AS BIGINT) AS place FROM (SELECT p_type, min(p_size * 1000000 + p_partkey) AS first FROM part WHERE p_size > 5 GROUP BY 1)""")
def ordered_stages(spark: SparkSession, d: str) -> DataFrame:
    """SRT08: groups by the smallest order of their members; groups without members don't show. A row a kind."""
    kinds = table(spark, d, "part").where("p_size > 5").groupBy("p_type").agg(F.min(F.col("p_size") * 1000000 + F.col("p_partkey")).alias("first"))
    return kinds.select("p_type", F.col("first").cast("bigint").alias("first"), F.row_number().over(Window.orderBy("first", "p_type")).cast("bigint").alias("place"))


@query("""SELECT name, kind FROM (SELECT n_name AS name, 'nation' AS kind, 1 AS o FROM nation UNION ALL SELECT r_name, 'region', 0 FROM region) ORDER BY o, name""")
def headed_groups(spark: SparkSession, d: str) -> DataFrame:
    """SRT06, SRT07, ADD15: groups in a fixed order of kinds, names within."""
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).union(table(spark, d, "region").select("r_name", F.lit("region")))
    return rows.orderBy(F.array_position(F.array(F.lit("region"), F.lit("nation")), F.col("kind")), "name")
