"""Data quality and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.operators import rules as Q
from sorrel.plans.metrics import _YEARLY, yearly
from sorrel.plans.registry import query
from sorrel.sources.tables import table


@query("""SELECT 'customer' AS file, CAST(c_custkey AS VARCHAR) AS key, 'negative balance' AS rule, 'warning' AS severity FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'bad name', 'error' FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'unknown segment', 'error' FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD')
UNION ALL SELECT 'customer', CAST(c_nationkey AS VARCHAR), 'unknown nation', 'error' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 9 <> 4)
UNION ALL SELECT 'part', p_name || '/' || p_brand, 'repeated name', 'error' FROM part GROUP BY p_name, p_brand HAVING count(*) > 1
UNION ALL SELECT 'lineitem', l_orderkey || '/' || l_linenumber, 'shipped before order', 'error' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def catalog_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ01: formats, ranges, enumerations, references, repeats and order of dates as one list of problems."""
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    own = Q.row_rules(c, "customer", F.col("c_custkey"), [
        ("negative balance", F.col("c_acctbal") < 0, "warning"),
        ("bad name", ~F.col("c_name").rlike("^Customer#[0-9]{9}$"), "error"),
        ("unknown segment", ~F.col("c_mktsegment").isin("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD"), "error"),
    ])
    nations = Q.missing_targets(c, "c_nationkey", table(spark, d, "nation").where("n_nationkey % 9 <> 4"), "n_nationkey", "customer", "unknown nation")
    names = Q.repeated(p, F.concat_ws("/", "p_name", "p_brand"), "part", "repeated name")
    dated = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Q.row_rules(dated, "lineitem", F.concat_ws("/", "l_orderkey", "l_linenumber"), [("shipped before order", F.col("l_shipdate") < F.col("o_orderdate"), "error")])
    return Q.all_problems(own, nations, names, order)


# A year's figures as read: some in a wrong unit, some missing, some whose parts don't add up; documents that failed.
_READ = f"""{_YEARLY}, y AS (SELECT o_custkey, fy, CAST(CASE WHEN o_custkey % 10 = 0 AND fy = 1995 THEN sales * 1000 ELSE sales END AS DOUBLE) AS sales, CASE WHEN o_custkey % 9 = 0 AND fy = 1996 THEN NULL ELSE CAST(profit AS DOUBLE) END AS profit, CAST(sales AS DOUBLE) * CASE WHEN o_custkey % 8 = 0 THEN 0.9 ELSE 1 END AS parts FROM yearly),
w AS (SELECT a.*, b.sales AS s, b.profit AS p, b.fy IS NOT NULL AS there FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND b.fy = a.fy - 1)"""


@query(f"""WITH {_READ} SELECT o_custkey, CAST(fy AS BIGINT) AS fy, kind FROM (SELECT o_custkey, fy, unnest(list_filter([CASE WHEN there AND p IS NOT NULL AND profit IS NULL THEN 'missing' END, CASE WHEN s <> 0 AND abs(sales / s - 1) > 0.5 THEN 'jump' END, CASE WHEN p <> 0 AND profit <> 0 AND (p > 0) <> (profit > 0) THEN 'sign' END,
CASE WHEN s <> 0 AND sales <> 0 AND (abs(sales / s) BETWEEN 700 AND 1400 OR abs(s / sales) BETWEEN 700 AND 1400) THEN 'unit' END, CASE WHEN sales <> 0 AND abs(parts - sales) / abs(sales) > 0.05 THEN 'parts' END], lambda x: x IS NOT NULL)) AS kind FROM w)
UNION ALL SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT), 'failed' FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= DATE '1998-01-01' GROUP BY ALL""")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """MTH17, INC22: a period against the one a year before: a value gone, a jump over half, a sign change, a factor of 700 to 1400 either way, parts that miss the total by over 5 %; documents that failed of late."""
    y = yearly(spark, d)
    sales = F.when((F.col("o_custkey") % 10 == 0) & (F.col("fy") == 1995), F.col("sales") * 1000).otherwise(F.col("sales")).cast("double")
    profit = F.when((F.col("o_custkey") % 9 == 0) & (F.col("fy") == 1996), None).otherwise(F.col("profit")).cast("double")
    parts = F.col("sales").cast("double") * F.when(F.col("o_custkey") % 8 == 0, 0.9).otherwise(1.0)
    read = y.select("o_custkey", "fy", sales.alias("sales"), profit.alias("profit"), parts.alias("parts"))
    before = read.select("o_custkey", (F.col("fy") + 1).alias("fy"), F.col("sales").alias("s"), F.col("profit").alias("p"), F.lit(True).alias("there"))
    w = read.join(before, ["o_custkey", "fy"], "left")
    s, p, now, own = F.col("s"), F.col("p"), F.col("sales"), F.col("profit")
    rules = {
        "missing": F.col("there") & p.isNotNull() & own.isNull(),
        "jump": (s != 0) & (F.abs(F.try_divide(now, s) - 1) > 0.5),
        "sign": (p != 0) & (own != 0) & ((p > 0) != (own > 0)),
        "unit": (s != 0) & (now != 0) & (F.abs(F.try_divide(now, s)).between(700, 1400) | F.abs(F.try_divide(s, now)).between(700, 1400)),
        "parts": (now != 0) & (F.try_divide(F.abs(F.col("parts") - now), F.abs(now)) > 0.05),
    }
    kinds = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    failed = table(spark, d, "orders").where("o_orderstatus = 'P'").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_custkey", F.year("o_orderdate").cast("bigint").alias("fy"), F.lit("failed").alias("kind")).distinct()
    return w.select("o_custkey", F.col("fy").cast("bigint").alias("fy"), F.explode(kinds).alias("kind")).unionByName(failed)


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN length(text) > 20000 THEN 'long' END, CASE WHEN regexp_matches(text, '[0-9]{6,}') THEN 'digits' END, CASE WHEN contains(text, '<') THEN 'markup' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'link' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents""")
def output_gates(spark: SparkSession, d: str) -> DataFrame:
    """DQ20: the rules that a generated text fails: length, digits, markup, links."""
    n, t = F.length("text"), F.col("text")
    rules = [(n < 200, "short"), (n > 20000, "long"), (t.rlike("[0-9]{6,}"), "digits"), (F.contains(t, F.lit("<")), "markup"), (t.rlike("https?://"), "link")]
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", *(F.when(bad, name) for bad, name in rules)).alias("failed"))
