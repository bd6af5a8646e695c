"""Drafts checked against their sources: claims with places, verdicts, acknowledgements, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.operators import factcheck
from sorrel.operators.claims import unacknowledged
from sorrel.plans.registry import query
from sorrel.sources.tables import table

#: Names that are known; a fixed small list.
NAMES = ["東京エレクトロン", "大阪化学"]

# What each order's draft claims, written out from its columns, and the verdict that its source leads to.
_EXPECTED = """t AS (SELECT o_orderkey, o_orderstatus AS s, CAST(year(o_orderdate) AS VARCHAR) || '年' || CAST(month(o_orderdate) AS VARCHAR) || '月' AS d, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '百万円' AS n,
  CASE o_orderstatus WHEN 'F' THEN '東京エレクトロン' WHEN 'O' THEN '東京エレクトロム' ELSE '未知製作所' END AS p, 'https://a.example/' || CAST(o_orderkey AS VARCHAR) AS u FROM orders),
c AS (SELECT o_orderkey, s, 1 AS no, 'date' AS kind, d AS claim, 0 AS start, NULL AS unit, '' AS label FROM t UNION ALL SELECT o_orderkey, s, 2, 'number', n, length(d) + 5, '百万円', '売上高' FROM t
  UNION ALL SELECT o_orderkey, s, 3, 'proper', p, length(d || n) + 6, NULL, '' FROM t UNION ALL SELECT o_orderkey, s, 4, 'url', u, length(d || n || p) + 10, NULL, '' FROM t),
v AS (SELECT *, CASE WHEN s = 'F' THEN 'grounded' WHEN s = 'O' AND kind <> 'date' THEN 'contradiction' WHEN kind <> 'url' AND o_orderkey % 5 = 0 THEN 'unverifiable' ELSE 'unsupported' END AS verdict, substr(sha1(kind || ':' || claim), 1, 10) AS print FROM c)"""


def drafts_and_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A draft for each order; sources that say the same, another amount, or nothing, by its status; listed addresses; documents with a source that failed."""
    o = table(spark, d, "orders")
    s, n = F.col("o_orderstatus"), F.floor("o_totalprice").cast("bigint")
    day = F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), F.month("o_orderdate").cast("string"), F.lit("月"))
    name = F.when(s == "F", "東京エレクトロン").when(s == "O", "東京エレクトロム").otherwise("未知製作所")
    url = F.concat(F.lit("https://a.example/"), F.col("o_orderkey").cast("string"))
    drafts = o.select("o_orderkey", F.concat(day, F.lit("、売上高は"), n.cast("string"), F.lit("百万円。"), name, F.lit("の発表 "), url).alias("text"))
    same = F.concat(F.lit("売上高 "), F.format_number(n, 0), F.lit("百万円、"), day, F.dayofmonth("o_orderdate").cast("string"), F.lit("日"))
    other = F.concat(F.lit("売上高 "), F.format_number(n + 1000, 0), F.lit("百万円"))
    sources = o.select("o_orderkey", F.lit("S1").alias("source"), F.when(s == "F", same).when(s == "O", other).otherwise("資料なし").alias("text"))
    listed = o.where(s != "P").select("o_orderkey", F.concat(url, F.lit("/")).alias("url"), F.when(s == "F", 200).otherwise(404).alias("status"))
    return drafts, sources, listed, o.where("o_orderkey % 5 = 0").select("o_orderkey")


def results(spark: SparkSession, d: str) -> DataFrame:
    drafts, sources, listed, failed = drafts_and_sources(spark, d)
    return factcheck.check(drafts, sources, listed, NAMES, "o_orderkey", "text", failed)


@query(f"WITH {_EXPECTED} SELECT o_orderkey, no, kind, claim, start, unit, label FROM v")
def drafted_claims(spark: SparkSession, d: str) -> DataFrame:
    """STR12, STR13, STR14, STR03, MTH18, MTH19: dates, amounts with unit and label, addresses and names of texts, misspelt ones included, with their places.

    The SQL writes the claims out from the columns that the texts are made from.
    """
    drafts, *_ = drafts_and_sources(spark, d)
    return factcheck.claims(drafts, "o_orderkey", "text", NAMES).select("o_orderkey", "no", "kind", "claim", "start", "unit", "label")


@query(f"WITH {_EXPECTED} SELECT o_orderkey, no, kind, verdict, print FROM v")
def checked_drafts(spark: SparkSession, d: str) -> DataFrame:
    """MTH09 to MTH13, STR15, DAT13, ADD36, JON20, INC25, INC27, STR42: a verdict for each claim by its document's sources, dictionary and listed addresses; without a readable source nothing is called unsupported."""
    return results(spark, d).select("o_orderkey", "no", "kind", "verdict", "print")


@query(f"WITH {_EXPECTED} SELECT o_orderkey AS file, print FROM v WHERE verdict <> 'grounded' AND claim <> '未知製作所' AND NOT (kind = 'url' AND o_orderkey % 3 = 0)")
def open_claims(spark: SparkSession, d: str) -> DataFrame:
    """INC26, INC28: what is neither grounded nor acknowledged, for its own file or for all."""
    rows = results(spark, d).withColumnRenamed("o_orderkey", "file")
    everywhere = rows.where("claim = '未知製作所'").select(F.lit(None).cast("bigint").alias("file"), "print").distinct()
    here = rows.where("kind = 'url' and file % 3 = 0").select("file", "print")
    return unacknowledged(rows.select("file", "print", "verdict"), everywhere.unionByName(here)).select("file", "print")


@query(f"""WITH {_EXPECTED} SELECT kind, count(*) FILTER (verdict = 'grounded') AS grounded, count(*) FILTER (verdict = 'contradiction') AS contradiction, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'unverifiable') AS unverifiable,
count(*) FILTER (verdict <> 'grounded' AND o_orderkey % 3 = 0) AS acknowledged FROM v GROUP BY 1""")
def claim_report(spark: SparkSession, d: str) -> DataFrame:
    """AGG11: claims by kind and verdict, and how many of those that aren't grounded are acknowledged."""
    v = F.col("verdict")
    counts = [F.count_if(v == x).alias(x) for x in ("grounded", "contradiction", "unsupported", "unverifiable")]
    return results(spark, d).groupBy("kind").agg(*counts, F.count_if((v != "grounded") & (F.col("o_orderkey") % 3 == 0)).alias("acknowledged"))


@query(f"WITH {_EXPECTED} SELECT o_orderkey, no, CASE WHEN verdict = 'grounded' THEN 'nothing to record' WHEN verdict = 'contradiction' AND o_orderkey % 2 = 0 THEN 'needs a cause' END AS refused FROM v")
def refused_acknowledgements(spark: SparkSession, d: str) -> DataFrame:
    """DQ24: acknowledgements that can't be recorded: of grounded claims, and of contradictions without a cause (here of even orders)."""
    v = F.col("verdict")
    refused = F.when(v == "grounded", "nothing to record").when((v == "contradiction") & (F.col("o_orderkey") % 2 == 0), "needs a cause")
    return results(spark, d).select("o_orderkey", "no", refused.alias("refused"))


@query("""SELECT DISTINCT word FROM (SELECT lower(p_name) AS word FROM part UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT lower(s_name) FROM supplier) WHERE word <> ''""")
def dictionary_words(spark: SparkSession, d: str) -> DataFrame:
    """ADD33: the names and aliases of all masters as one list of distinct words."""
    p = table(spark, d, "part")
    parts = [p.select(F.lower("p_name").alias("word")), p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")), table(spark, d, "nation").select(F.lower("n_name").alias("word")), table(spark, d, "supplier").select(F.lower("s_name").alias("word"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("word <> ''").distinct()


@query("""WITH w AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 2 = 0 THEN replace(c_name, '#', '') ELSE replace(s_name, '#', '') END AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier))
SELECT o_orderkey, 6 AS place, CASE s WHEN 'O' THEN left(name, length(name) - 1) || 'x' ELSE left(name, 3) || substr(name, 5) END AS form FROM w WHERE s <> 'F'""")
def misspelt_names(spark: SparkSession, d: str) -> DataFrame:
    """STR12: names with one wrong letter in texts, by a dictionary table of all customers', suppliers' and parts' names.

    An order's text names its customer or a supplier: rightly, with another last letter, or with a letter left out, by its
    status.
    """
    c, s, p = (table(spark, d, t) for t in ("customer", "supplier", "part"))
    plain = lambda x: F.replace(x, F.lit("#"), F.lit(""))
    words = c.select(plain(F.col("c_name")).alias("word")).unionByName(s.select(plain(F.col("s_name")).alias("word"))).unionByName(p.select(F.col("p_name").alias("word")))
    o = table(spark, d, "orders").join(c.hint("merge"), F.col("c_custkey") == F.col("o_custkey")).withColumn("place_", F.col("o_custkey") % s.count())
    o = o.join(s, F.col("s_suppkey") == F.col("place_")).withColumn("name", plain(F.when(F.col("o_orderkey") % 2 == 0, F.col("c_name")).otherwise(F.col("s_name"))))
    said = F.when(F.col("o_orderstatus") == "O", F.concat(F.expr("left(name, length(name) - 1)"), F.lit("x"))).when(F.col("o_orderstatus") == "F", F.col("name")).otherwise(F.concat(F.expr("left(name, 3)"), F.expr("substring(name, 5)")))
    return factcheck.misspelt(o.select("o_orderkey", F.concat(F.lit("Order "), said, F.lit(" of parts")).alias("text")), "o_orderkey", "text", words)
