"""Set operations: collecting without repeats, upserts, unions of kinds, differences both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.operators import relational as R
from sorrel.plans.registry import query
from sorrel.sources.tables import table

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^&]*&?)+', '\1', 'g'), '[?&]+$', ''), '[?]&', '?')"""


@query(rf"""WITH s AS (SELECT page_id, 1 AS src, url FROM pages UNION ALL SELECT page_id + 1000000, 2, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=rss' FROM pages WHERE page_id % 3 = 0),
n AS (SELECT page_id, src, {_CLEAN} AS key FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, page_id) AS r FROM n)
SELECT page_id, key FROM k WHERE r = 1 AND key NOT IN (SELECT {_CLEAN} FROM pages WHERE page_id % 7 = 0)""")
def collected_pages(spark: SparkSession, d: str) -> DataFrame:
    """SET01, STR01, SRC18: sources united, the first of each normalised URL, without those seen before."""
    p = table(spark, d, "pages").select("page_id", "url")
    again = p.where("page_id % 3 = 0").select((F.col("page_id") + 1000000).alias("page_id"), F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=rss")).alias("url"))
    both = p.withColumn("src", F.lit(1)).unionByName(again.withColumn("src", F.lit(2))).withColumn("key", S.normalize_url(F.col("url")))
    seen = p.where("page_id % 7 = 0").select(S.normalize_url(F.col("url")).alias("key"))
    return R.first_seen(both, "key", ["src", "page_id"], seen).select("page_id", "key")


@query("""SELECT o_orderkey, o_totalprice, 'kept' AS change FROM orders WHERE o_orderdate < DATE '1995-01-01' UNION ALL
SELECT o_orderkey, o_totalprice + 1, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'replaced' ELSE 'added' END FROM orders WHERE o_orderdate >= DATE '1995-01-01'""")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """SET03, SET04, SET10: new rows replace those of the same key; every row says what happened."""
    o, day = table(spark, d, "orders"), F.col("o_orderdate").cast("date")
    base = o.where(day < F.lit("1996-01-01").cast("date")).select("o_orderkey", "o_totalprice")
    new = o.where(day >= F.lit("1995-01-01").cast("date")).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return R.upsert(base, new, ["o_orderkey"])


@query("""SELECT kind, key FROM (SELECT DISTINCT 'part' AS kind, unnest(string_split(lower(p_name), ' ')) AS key FROM part UNION ALL SELECT DISTINCT 'nation', lower(n_name) FROM nation UNION ALL SELECT DISTINCT 'region', lower(r_name) FROM region) WHERE length(key) >= 2""")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    """SET05, SET06, ADD33: names of several kinds as one list of distinct keys of two characters at least."""
    part = table(spark, d, "part").select(F.lit("part").alias("kind"), F.explode(F.split(F.lower("p_name"), " ")).alias("key")).distinct()
    nation = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.lower("n_name").alias("key")).distinct()
    region = table(spark, d, "region").select(F.lit("region").alias("kind"), F.lower("r_name").alias("key")).distinct()
    return part.unionByName(nation).unionByName(region).where(F.length("key") >= 2)


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter(w, lambda x: x NOT IN ('red', 'blue', 'ring'))), ',') AS unknown, array_to_string(list_sort(list_filter(['red', 'blue', 'ring'], lambda x: NOT list_contains(w, x))), ',') AS unused FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS w FROM part)""")
def citation_differences(spark: SparkSession, d: str) -> DataFrame:
    """SET07, SET08: cited but not listed, and listed but not cited."""
    cited, listed = F.split("p_name", " "), F.array(*map(F.lit, ("red", "blue", "ring")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(F.array_except(cited, listed)), ",").alias("unknown"), F.array_join(F.sort_array(F.array_except(listed, cited)), ",").alias("unused"))


@query("""SELECT 'not in enum' AS side, o_orderstatus AS value FROM (SELECT DISTINCT o_orderstatus FROM orders EXCEPT SELECT unnest(['F', 'O', 'X'])) UNION ALL SELECT 'not in data', v FROM (SELECT unnest(['F', 'O', 'X']) AS v EXCEPT SELECT o_orderstatus FROM orders)""")
def enum_parity(spark: SparkSession, d: str) -> DataFrame:
    """SET09: values that only the data or only the enumeration has."""
    data = table(spark, d, "orders").select(F.col("o_orderstatus").alias("value")).distinct()
    enum = spark.createDataFrame([("F",), ("O",), ("X",)], "value string")
    side = lambda df, name: df.select(F.lit(name).alias("side"), "value")
    return side(data.subtract(enum), "not in enum").unionByName(side(enum.subtract(data), "not in data"))


@query("""SELECT user_id, event_type, strftime(first, '%Y-%m-%d %H:%M:%S') AS first FROM (SELECT user_id, event_type, min(ts) AS first FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM events y WHERE y.user_id = x.user_id AND y.event_type = x.event_type AND y.ts >= TIMESTAMP '2024-01-20')""")
def vanished_keys(spark: SparkSession, d: str) -> DataFrame:
    """SET02: keys of one side that the other side doesn't have, with their first time."""
    e = table(spark, d, "events")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    old = e.where(F.col("ts") < cut).groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    new = e.where(F.col("ts") >= cut).select("user_id", "event_type").distinct()
    return old.join(new, ["user_id", "event_type"], "left_anti").select("user_id", "event_type", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"))


@query("""SELECT c_custkey, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM (SELECT o_custkey AS c_custkey, run, min(y) AS first, max(y) AS last FROM (SELECT o_custkey, y, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS run FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders)) GROUP BY 1, 2)""")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """STR40: runs of consecutive numbers as first and last."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    return R.islands(o, ["c_custkey"], "y").select("c_custkey", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))
