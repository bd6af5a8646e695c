"""Joins and filters: dimension lookups, candidates, earlier periods, references, peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.operators import relational as R
from sorrel.plans.metrics import money
from sorrel.plans.registry import query
from sorrel.sources.tables import table


@query("SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus IN ('F', 'O')")
def select_filings(spark: SparkSession, d: str) -> DataFrame:
    """FLT01: rows of known companies and kinds, projected with the company's name."""
    known = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).join(known, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'withdrawn' WHEN c_custkey IS NULL THEN 'code mismatch' WHEN o_orderkey % 7 = 0 THEN 'bad id' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown type' ELSE 'ok' END AS reason
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0) GROUP BY 1""")
def classify_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT02: an ordered cascade of reasons; the first that holds counts."""
    known = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    rows = table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    reason = F.when(F.col("o_orderstatus") == "P", "withdrawn").when(F.col("c_custkey").isNull(), "code mismatch").when(F.col("o_orderkey") % 7 == 0, "bad id").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown type").otherwise("ok")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3,}') AND NOT text LIKE '%Block'")
def numeric_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT03, SRC12: texts with figures."""
    return table(spark, d, "documents").where(F.col("text").rlike("[0-9]{3,}") & ~F.col("text").endswith("Block")).select("doc_id")


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 5")
def upcoming_events(spark: SparkSession, d: str) -> DataFrame:
    """FLT14: the next five from a given day."""
    e = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).orderBy("ts", "event_id").limit(5)
    return e.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND p_size BETWEEN 10 AND 40 AND p_type IN ('PROMO', 'ECONOMY')")
def faceted_parts(spark: SparkSession, d: str) -> DataFrame:
    """FLT15, FLT16: facets combined by and; an empty facet lets all through."""
    return table(spark, d, "part").where(F.array_contains(F.split("p_name", " "), "red") & F.col("p_size").between(10, 40) & F.col("p_type").isin("PROMO", "ECONOMY")).select("p_partkey")


@query(r"""SELECT page_id, host, allowed FROM (SELECT page_id, host, host = 'example.com' OR host LIKE '%.example.com' AS allowed FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages))""")
def allowed_pages(spark: SparkSession, d: str) -> DataFrame:
    """FLT20, ADD50: hosts, and whether they are an allowed domain or below one."""
    return table(spark, d, "pages").select("page_id", S.host_key(F.col("url")).alias("host")).withColumn("allowed", S.domain_allowed(F.col("host"), ["example.com"]))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?]page=') THEN 'list' WHEN regexp_matches(url, '/[a-z]{2}/[0-9]+([?#].*)?$') THEN 'article' WHEN regexp_matches(url, '#') THEN 'anchor' ELSE 'other' END AS kind FROM pages""")
def kind_of_path(spark: SparkSession, d: str) -> DataFrame:
    """FLT22, SRC19: a page's kind by the first pattern that fits its path."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(u.rlike("[?]page="), "list").when(u.rlike(r"/[a-z]{2}/[0-9]+([?#].*)?$"), "article").when(u.rlike("#"), "anchor").otherwise("other").alias("kind"))


@query("""WITH cand(priority, prefix) AS (VALUES (1, 'red'), (2, 'small'), (3, 'blue')),
met AS (SELECT p_brand, p_partkey, p_name, p_retailprice, priority, min(priority) OVER (PARTITION BY p_brand) AS low FROM part JOIN cand ON starts_with(p_name, prefix)),
best AS (SELECT *, min(p_name) OVER (PARTITION BY p_brand) <> max(p_name) OVER (PARTITION BY p_brand) AS conflict FROM met WHERE priority = low)
SELECT p_brand, p_partkey, p_name, CAST(priority AS BIGINT) AS priority, conflict FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM best) WHERE k = 1""")
def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    """JON02, NST09: the first candidate with rows wins, its first row counts, differing values are a conflict."""
    candidates = spark.createDataFrame([(1, "red"), (2, "small"), (3, "blue")], "priority int, prefix string")  # a fixed small table
    parts = table(spark, d, "part").withColumn("value", F.col("p_name"))
    best = R.first_candidate(parts, candidates, parts["p_name"].startswith(candidates["prefix"]), ["p_brand"], "priority", ["p_partkey"])
    return best.select("p_brand", "p_partkey", "p_name", F.col("priority").cast("bigint").alias("priority"), "conflict")


@query(r"""WITH rules(pattern, label) AS (VALUES ('PROMO', 'promo'), ('*:LARGE', 'large'), ('*:SMALL', 'small'))
SELECT p_partkey, label FROM part JOIN rules ON p_type = pattern OR (starts_with(pattern, '*:') AND p_type = substr(pattern, 3) AND p_brand = 'Brand#2')""")
def wildcard_matches(spark: SparkSession, d: str) -> DataFrame:
    """JON03: literal rules, and wildcard rules that hold for one issuer only; the rules are a fixed small table."""
    rules = spark.createDataFrame([("PROMO", "promo"), ("*:LARGE", "large"), ("*:SMALL", "small")], "pattern string, label string")
    local = F.col("pattern").startswith("*:") & (F.col("p_type") == F.expr("substr(pattern, 3)")) & (F.col("p_brand") == "Brand#2")
    return table(spark, d, "part").join(rules, (F.col("p_type") == F.col("pattern")) | local).select("p_partkey", "label")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, previous_key FROM (SELECT a.o_orderkey, b.o_orderkey AS previous_key, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY CASE WHEN b.o_orderstatus = a.o_orderstatus THEN 1 ELSE 0 END DESC, b.o_orderkey DESC) AS k
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.day - b.day BETWEEN 350 AND 380) WHERE k = 1""")
def previous_period(spark: SparkSession, d: str) -> DataFrame:
    """JON04: the row a year earlier (350 to 380 days), of the same source first, then the last one."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    return R.earlier_period(o, ["o_custkey"], "day", 350, 380, "o_orderstatus", "o_orderkey").select("o_orderkey", F.col("previous.o_orderkey").alias("previous_key"))


@query("""SELECT event_id, total FROM (SELECT event_id, 1 + CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END + CAST(floor(value) AS BIGINT) % 5 AS total, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS k FROM events JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') USING (user_id)) WHERE k = 1""")
def merged_scores(spark: SparkSession, d: str) -> DataFrame:
    """JON05: outputs joined with known candidates, the first of repeated ids, scores added up."""
    e = table(spark, d, "events")
    known = e.where("event_type = 'signup'").select("user_id").distinct()
    rows = R.first_per_key(e.join(known, "user_id"), ["event_id"], ["ts"])
    kind = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return rows.select("event_id", (F.lit(1) + kind + F.floor("value") % 5).cast("bigint").alias("total"))


@query("""SELECT n_name, c_custkey, CAST(row_number() OVER (PARTITION BY n_name ORDER BY coalesce(code, 99999), c_custkey) AS BIGINT) AS place FROM (SELECT n_name, c_custkey, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) END AS code FROM nation JOIN customer ON c_nationkey = n_nationkey)""")
def grouped_rows(spark: SparkSession, d: str) -> DataFrame:
    """JON07: entries joined with their master, unmatched ones dropped, sorted with missing codes last."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", "c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")), F.lit(99999)).alias("code"))
    return R.places(rows, ["n_name"], ["code", "c_custkey"]).select("n_name", "c_custkey", "place")


@query("""SELECT p_partkey, string_agg(label, ',' ORDER BY place) AS tags FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS slug, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part) JOIN (VALUES ('red', 'Red'), ('blue', 'Blue'), ('small', 'Small'), ('ring', 'Ring')) names(slug, label) USING (slug) GROUP BY 1""")
def theme_tags(spark: SparkSession, d: str) -> DataFrame:
    """JON08, ADD14: slugs to names in their order, unmatched ones dropped."""
    names = spark.createDataFrame([("red", "Red"), ("blue", "Blue"), ("small", "Small"), ("ring", "Ring")], "slug string, label string")
    slugs = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "slug")).join(names, "slug")
    return slugs.groupBy("p_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), ",").alias("tags"))


@query("""WITH parts AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT a.l_suppkey AS supplier, b.l_suppkey AS peer, count(*) AS shared FROM parts a JOIN parts b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def peers(spark: SparkSession, d: str) -> DataFrame:
    """JON09: suppliers that share parts which were sent back (a status of the line); an equi-join on the shared element, counted before it leaves the task."""
    p = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct()
    salts = 8  # a part that most suppliers have is dealt over as many tasks
    a = p.withColumnRenamed("l_suppkey", "supplier").withColumn("salt", F.pmod(F.xxhash64("supplier"), F.lit(salts)))
    b = p.withColumnRenamed("l_suppkey", "peer").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return a.join(b, ["l_partkey", "salt"]).where("supplier < peer").groupBy("supplier", "peer").agg(F.count("*").alias("shared"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS most FROM supplier WHERE s_acctbal IS NOT NULL")
def peer_maximum(spark: SparkSession, d: str) -> DataFrame:
    """JON10: a group's rows with the group's maximum."""
    rows = table(spark, d, "supplier").where("s_acctbal is not null").select("s_suppkey", "s_nationkey", "s_acctbal")
    most = rows.groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("most"))
    return rows.join(most, F.col("s_nationkey").eqNullSafe(F.col("nation"))).drop("nation")


@query("""SELECT p_partkey, CASE WHEN len(own) > 0 THEN array_to_string(own[:2], ',') ELSE lower(p_type) END AS tags FROM (SELECT p_partkey, p_type, CASE WHEN contains(p_name, 'red') THEN ['red'] ELSE [] END || CASE WHEN contains(p_name, 'blue') THEN ['blue'] ELSE [] END || CASE WHEN contains(p_name, 'small') THEN ['small'] ELSE [] END AS own FROM part)""")
def fallback_tags(spark: SparkSession, d: str) -> DataFrame:
    """JON11, ADD08: the first two own tags in a fixed order, else a fallback."""
    own = F.filter(F.array(*map(F.lit, ("red", "blue", "small"))), lambda w: F.contains(F.col("p_name"), w))
    return table(spark, d, "part").select("p_partkey", F.when(F.size(own) > 0, F.array_join(F.slice(own, 1, 2), ",")).otherwise(F.lower("p_type")).alias("tags"))


@query("SELECT n_name, r_name, CAST(lag(n_nationkey) OVER w AS BIGINT) AS before, CAST(lead(n_nationkey) OVER w AS BIGINT) AS after FROM nation JOIN region ON n_regionkey = r_regionkey WINDOW w AS (PARTITION BY r_regionkey ORDER BY n_nationkey)")
def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    """JON14, GRF06, WIN07: a hierarchy flattened, each unit with its neighbours in order."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = Window.partitionBy("r_regionkey").orderBy("n_nationkey")
    return rows.select("n_name", "r_name", F.lag("n_nationkey").over(by).cast("bigint").alias("before"), F.lead("n_nationkey").over(by).cast("bigint").alias("after"))


@query("""SELECT 'order without customer' AS rule, CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
UNION ALL SELECT 'repeated line', l_orderkey || '/' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def integrity_problems(spark: SparkSession, d: str) -> DataFrame:
    """JON16: references without a target and repeated keys, as one list of problems."""
    o, c, l = table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 10 <> 3"), table(spark, d, "lineitem")  # noqa: E741
    return R.orphans(o, c, "o_custkey", "c_custkey", "order without customer").unionByName(R.duplicates(l, ["l_orderkey", "l_linenumber"], "repeated line"))


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def new_targets(spark: SparkSession, d: str) -> DataFrame:
    """JON17, SET02: usable listed documents that aren't known yet."""
    known = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").distinct().join(known, "o_orderkey", "left_anti")


_AFTER = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 19 = 0"


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders), b AS ({_AFTER})
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change, a.status AS old_status, b.status AS new_status, a.price AS old_price, b.price AS new_price
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """JON18, JON19, FLT10, INC22: rows added, removed or changed between two snapshots."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    before = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    after = before.where(k % 17 != 0).select("o_orderkey", F.when(k % 11 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(k % 13 != 0, F.col("price")).alias("price")).union(before.where(k % 19 == 0).select(-k - 1, "status", "price"))
    return R.snapshot_diff(before, after, ["o_orderkey"], ["status", "price"])


@query("""SELECT p_partkey, CASE WHEN word IN ('ring', 'widget') THEN 'known' WHEN levenshtein(word, 'ring') BETWEEN 1 AND 2 OR levenshtein(word, 'widget') BETWEEN 1 AND 2 THEN 'misspelt' ELSE 'unknown' END AS verdict FROM (SELECT p_partkey, string_split(p_name, ' ')[2] AS word FROM part)""")
def proper_names(spark: SparkSession, d: str) -> DataFrame:
    """JON20, STR11: dictionary words, near misses by edit distance, others."""
    word = F.element_at(F.split("p_name", " "), 2)
    near = F.levenshtein(word, F.lit("ring")).between(1, 2) | F.levenshtein(word, F.lit("widget")).between(1, 2)
    return table(spark, d, "part").select("p_partkey", F.when(word.isin("ring", "widget"), "known").when(near, "misspelt").otherwise("unknown").alias("verdict"))


@query("""SELECT kind, ref, coalesce(c_name, s_name, n_name) AS name FROM (SELECT 'customer' AS kind, c_custkey AS ref FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT) FROM nation UNION ALL SELECT 'nation', 999)
LEFT JOIN customer ON kind = 'customer' AND ref = c_custkey LEFT JOIN supplier ON kind = 'supplier' AND ref = s_suppkey LEFT JOIN nation ON kind = 'nation' AND ref = n_nationkey""")
def tagged_references(spark: SparkSession, d: str) -> DataFrame:
    """JON21, ADD01: references to one of three kinds, resolved by one join with the dimensions' union."""
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    dims = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("ref"), F.col("c_name").alias("name")).union(s.select(F.lit("supplier"), "s_suppkey", "s_name")).union(n.select(F.lit("nation"), F.col("n_nationkey").cast("bigint"), "n_name"))
    refs = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("ref")).union(s.select(F.lit("supplier"), "s_suppkey")).union(n.select(F.lit("nation"), F.col("n_nationkey").cast("bigint"))).union(spark.range(999, 1000).select(F.lit("nation"), "id"))
    return refs.join(dims, ["kind", "ref"], "left")


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)""")
def optional_hops(spark: SparkSession, d: str) -> DataFrame:
    """ADD03, ADD04: two hops through dimensions, and a comparison with an aggregate of all rows."""
    o = table(spark, d, "orders")
    nations = table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")
    mean = o.agg(F.avg(money("o_totalprice")).alias("mean"))
    c = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return o.join(F.broadcast(mean), F.col("o_totalprice") > F.col("mean")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")
