"""Dates, numbers and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.operators import nearest, setjoin
from sorrel.plans.metrics import money
from sorrel.plans.registry import query
from sorrel.plans.texts import PAIRS, PLAIN
from sorrel.sources.tables import table


@query("""SELECT o_orderkey, strftime(back + CAST(5 + 2 * ((isodow + 5) // 5) AS INTEGER), '%Y-%m-%d') AS deadline, back + CAST(5 + 2 * ((isodow + 5) // 5) AS INTEGER) < DATE '1998-08-02' AS stale
FROM (SELECT o_orderkey, d - greatest(isodow(d) - 5, 0)::INTEGER AS back, least(isodow(d), 5) - 1 AS isodow FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders))""")
def business_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """DAT06, DAT07: the fifth weekday after a date, and whether it lies before a given day."""
    due = S.add_business_days(F.col("o_orderdate").cast("date"), 5)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(due, "yyyy-MM-dd").alias("deadline"), (due < F.lit("1998-08-02").cast("date")).alias("stale"))


@query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH - INTERVAL 1 DAY, '%Y-%m') AS fiscal_end, lpad(CAST(year(o_orderdate) - 1 AS VARCHAR), 4, '0') || strftime(o_orderdate, '-%m') AS prior,
strftime(o_orderdate, '%Y') || '/' || CAST(month(o_orderdate) AS VARCHAR) || CASE WHEN o_orderstatus = 'F' THEN ' H' ELSE '' END AS label FROM orders""")
def fiscal_periods(spark: SparkSession, d: str) -> DataFrame:
    """DAT03, DAT04, DAT09, WIN12: the end of the year that starts at a date, the same month a year before, a label."""
    day = F.col("o_orderdate").cast("date")
    month = F.date_format(day, "yyyy-MM")
    prior = F.concat(F.lpad((F.year(day) - 1).cast("string"), 4, "0"), F.date_format(day, "-MM"))
    return table(spark, d, "orders").select("o_orderkey", S.half_year_end(day).alias("fiscal_end"), prior.alias("prior"), S.period_label(month, F.when(F.col("o_orderstatus") == "F", "half").otherwise("annual")).alias("label"))


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS local, CAST(try_strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS VARCHAR) AS parsed FROM events""")
def local_times(spark: SparkSession, d: str) -> DataFrame:
    """DAT01, DAT02: instants as local time with its offset; texts to the minute as timestamps."""
    ts = F.col("ts")
    text = F.date_format(ts, "yyyy-MM-dd HH:mm")
    parsed = F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", F.concat(F.date_format(ts + F.expr("interval 9 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")).alias("local"), parsed.alias("parsed"))


@query("""WITH e AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN a = b THEN CAST(a AS VARCHAR) WHEN strftime(a, '%Y%m') = strftime(b, '%Y%m') THEN CAST(a AS VARCHAR) || '~' || strftime(b, '%d') WHEN year(a) = year(b) THEN CAST(a AS VARCHAR) || '~' || strftime(b, '%m-%d') ELSE CAST(a AS VARCHAR) || '~' || CAST(b AS VARCHAR) END AS label FROM e""")
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """DAT10, DAT11: a range of dates without parts that repeat."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    return e.select("user_id", S.range_label(F.col("a"), F.col("b")).alias("label"))


@query("""SELECT strftime(day, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) LEFT JOIN events ON CAST(ts AS DATE) = day WHERE isodow(day) < 6 GROUP BY 1""")
def weekday_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC03, DAT12, DAT14: the weekdays of a fixed range, each with its rows, days without any included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day")).where(F.weekday("day") < 5)
    n = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.50' WHEN 2 THEN '-' || CAST(o_custkey AS VARCHAR) ELSE 'n/a' END AS text, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE NULL END AS f FROM orders)
SELECT o_orderkey, CAST(CASE WHEN regexp_matches(replace(text, ',', ''), '^-?[0-9]+([.][0-9]+)?$') THEN CAST(replace(text, ',', '') AS DECIMAL(24,6)) END AS DOUBLE) AS plain, CAST(CASE WHEN regexp_matches(replace(text, ',', ''), '^-?[0-9]+([.][0-9]+)?$') THEN CAST(replace(text, ',', '') AS DECIMAL(24,6)) END * f / 1000000 AS DOUBLE) AS million FROM t""")
def typed_amounts(spark: SparkSession, d: str) -> DataFrame:
    """MTH01, MTH02, MTH03, MTH18: texts as exact decimals, scaled by their unit; unknown units and other texts are null."""
    k = F.col("o_orderkey")
    whole = F.floor("o_totalprice").cast("bigint")
    grouped = F.regexp_replace(whole.cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
    text = F.when(k % 4 == 0, grouped).when(k % 4 == 1, F.concat(whole.cast("string"), F.lit(".50"))).when(k % 4 == 2, F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).otherwise("n/a")
    unit = F.when(k % 3 == 0, "yen").when(k % 3 == 1, "thousand_yen").otherwise("unknown")
    value = S.strict_decimal(text)
    return table(spark, d, "orders").select("o_orderkey", value.cast("double").alias("plain"), S.scaled(value.cast("decimal(24,6)"), unit).cast("double").alias("million"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN abs(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)) * 2000) < 1 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) = CAST(l_quantity AS DECIMAL(18,2)) * 2000 END AS same FROM lineitem""")
def tolerant_equality(spark: SparkSession, d: str) -> DataFrame:
    """MTH08: equal, or less than one apart where the unit is coarse."""
    unit = F.when(F.col("l_returnflag") == "A", "million_yen").otherwise("yen")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.same_amount(unit, money("l_extendedprice"), money("l_quantity") * 2000).alias("same"))


@query("""SELECT conv_id, CAST(sum(ceil(length(text) * 1.5)) AS BIGINT) AS tokens, CAST(round(sum(ceil(length(text) * 1.5) * CASE WHEN role = 'assistant' THEN 15 ELSE 3 END)::DECIMAL(30,6) / 1000000, 6) AS DOUBLE) AS most_cost FROM conversations GROUP BY 1""")
def cost_bounds(spark: SparkSession, d: str) -> DataFrame:
    """MTH15: an upper bound of cost from text lengths and the price of each role."""
    tokens = F.ceil(F.length("text") * F.lit(1.5).cast("decimal(2,1)")).cast("bigint")
    price = F.when(F.col("role") == "assistant", 15).otherwise(3)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(tokens).alias("tokens"), F.round(F.sum(tokens * price).cast("decimal(30,6)") / 1000000, 6).cast("double").alias("most_cost"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, json_valid(props) AS valid FROM events""")
def pointed_values(spark: SparkSession, d: str) -> DataFrame:
    """NST02, NST03, NST05: a value at a path of a JSON text; null where there is none."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("""SELECT c_custkey, unnest(['acctbal', 'nation', 'segment']) AS path, unnest([CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value FROM customer""")
def leaf_values(spark: SparkSession, d: str) -> DataFrame:
    """NST04: a flat record's leaves as rows of path and value; nested ones are `document_leaves`."""
    leaves = {"acctbal": money("c_acctbal").cast("string"), "nation": F.col("c_nationkey").cast("string"), "segment": F.col("c_mktsegment")}
    return table(spark, d, "customer").select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("path"), v.alias("value")) for k, v in leaves.items()))).alias("x")).select("c_custkey", "x.*")


@query("""SELECT o_orderkey, '{"status":"' || o_orderstatus || '","lines":[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']}' AS doc FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """NST07, NST10, NST11, SNK02, SNK04: rows folded into one canonical JSON document for each parent."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))).alias("lines"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.to_json(F.struct("status", "lines")).alias("doc"))


@query("""SELECT p_brand, CASE WHEN a IS NOT NULL THEN 'PROMO' WHEN b IS NOT NULL THEN 'SMALL' ELSE 'missing' END AS section, coalesce(a, b) AS p_partkey FROM (SELECT p_brand, min(CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN p_partkey END) AS a, min(CASE WHEN p_type = 'SMALL' THEN p_partkey END) AS b FROM part GROUP BY 1)""")
def picked_sections(spark: SparkSession, d: str) -> DataFrame:
    """NST09, ADD44, AGG24: the first candidate that is there for each section; what has none is reported missing."""
    by = table(spark, d, "part").groupBy("p_brand").agg(F.min(F.when((F.col("p_type") == "PROMO") & (F.col("p_size") > 40), F.col("p_partkey"))).alias("a"), F.min(F.when(F.col("p_type") == "SMALL", F.col("p_partkey"))).alias("b"))
    return by.select("p_brand", F.when(F.col("a").isNotNull(), "PROMO").when(F.col("b").isNotNull(), "SMALL").otherwise("missing").alias("section"), F.coalesce("a", "b").alias("p_partkey"))


def assigned_customers(spark: SparkSession, d: str) -> DataFrame:
    """JON15: suppliers and customers of a nation paired one to one by closeness of their balances; a custom fold, so without SQL."""
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation")
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation")
    return nearest.nearest_pairs(s, c, "nation", "s_suppkey", "c_custkey", ("s_acctbal", "c_acctbal"), 0.015)


query(None)(assigned_customers)


def _turns(spark: SparkSession, d: str, role: str, key: str) -> DataFrame:
    """A role's turns with their pairs of characters; of several texts of a turn the first in order counts."""
    c = table(spark, d, "conversations").where(F.col("role") == role).groupBy("conv_id", F.col("turn").cast("bigint").alias(key)).agg(F.min("text").alias("text"))
    return c.select("conv_id", key, S.letter_pairs(F.col("text")).alias("g"))


_TURNS = f"t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, {PLAIN} AS p FROM (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL)), g AS (SELECT *, {PAIRS} AS g FROM t), s AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(a.g || b.g)) AS DOUBLE) AS score FROM g AS a JOIN g AS b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant')"


@query(f"""WITH RECURSIVE {_TURNS},
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, i, j) AS k FROM s WHERE score >= 0.15),
f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS points, CAST([] AS BIGINT[]) AS claims, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS score FROM t
  UNION ALL
  SELECT f.conv_id, r.k, CASE WHEN free THEN list_append(f.points, r.i) ELSE f.points END, CASE WHEN free THEN list_append(f.claims, r.j) ELSE f.claims END, CASE WHEN free THEN r.i END, CASE WHEN free THEN r.j END, r.score
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1, LATERAL (SELECT NOT list_contains(f.points, r.i) AND NOT list_contains(f.claims, r.j) AS free)),
m AS (SELECT conv_id, i AS point, j AS claim, round(score, 9) AS score FROM f WHERE i IS NOT NULL)
SELECT * FROM m UNION ALL SELECT conv_id, turn, NULL, NULL FROM t WHERE role = 'user' AND (conv_id, turn) NOT IN (SELECT (conv_id, point) FROM m)
UNION ALL SELECT conv_id, NULL, turn, NULL FROM t WHERE role = 'assistant' AND (conv_id, turn) NOT IN (SELECT (conv_id, claim) FROM m)""")
def assigned_points(spark: SparkSession, d: str) -> DataFrame:
    """JON15, STR16: points and claims of a conversation paired one to one by common pairs of characters of their whole texts, best first, from 0.15 on; leftovers of both sides stay."""
    p, q = _turns(spark, d, "user", "point"), _turns(spark, d, "assistant", "claim")
    pairs = setjoin.assigned(p, q, "point", "claim", "g", 0.15, "conv_id")
    met = p.select("conv_id", "point").join(pairs, ["conv_id", "point"], "left").select("conv_id", "point", "claim", F.round("similarity", 9).alias("score"))
    alone = q.select("conv_id", "claim").join(pairs.select("conv_id", "claim"), ["conv_id", "claim"], "left_anti")
    return met.unionByName(alone.select("conv_id", F.lit(None).cast("bigint").alias("point"), "claim", F.lit(None).cast("double").alias("score")))


@query(f"""WITH {_TURNS} SELECT conv_id, turn AS error, (SELECT s.j FROM s WHERE s.conv_id = t.conv_id AND s.i = t.turn AND score >= 0.15 ORDER BY score DESC, j LIMIT 1) AS claim FROM t WHERE role = 'user'""")
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """AGG23, STR16: for each error the most similar claim of the same document by common pairs of characters, if there is one from 0.15 on."""
    errors = _turns(spark, d, "user", "error")
    best = setjoin.best_matches(errors, _turns(spark, d, "assistant", "claim"), "error", "claim", "g", 0.15, ["conv_id"])
    return errors.select("conv_id", "error").join(best.select("conv_id", "error", "claim"), ["conv_id", "error"], "left")
