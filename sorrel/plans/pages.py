"""Page-level queries: visibility, references resolved in order, lists for pages, labels and lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.operators import relational as R
from sorrel.plans.metrics import _YEARLY, money, yearly
from sorrel.plans.registry import query
from sorrel.sources.tables import table


def words_of(name: str = "p_name") -> Column:
    return F.split(name, " ")


def ordered_join(items: Column, separator: str = ",") -> Column:
    """The last fields of an array of (order..., text) structs, in order, as one text."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["name"]), separator)


@query("""SELECT doc_id, NOT coalesce(draft, false) AS shown, true AS in_preview FROM (SELECT doc_id, CASE WHEN length(text) > 0 THEN length(text) < 300 END AS draft FROM documents)""")
def visible_items(spark: SparkSession, d: str) -> DataFrame:
    """FLT11, SRC29, ADD69: drafts (here short texts) show in a preview alone; an item without the flag is no draft."""
    draft = F.when(F.length("text") > 0, F.length("text") < 300)
    show = lambda preview: ~F.coalesce(draft, F.lit(False)) | F.lit(preview)
    return table(spark, d, "documents").select("doc_id", show(False).alias("shown"), show(True).alias("in_preview"))


@query("""WITH s AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS overview, bool_or(o_orderstatus = 'O') AS auto, bool_and(o_orderpriority <> '1-URGENT') AS draft FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN NOT (coalesce(overview, false) AND coalesce(auto, false)) THEN false WHEN draft THEN false ELSE c_mktsegment = 'MACHINERY' END AS detailed, CASE WHEN NOT (coalesce(overview, false) AND coalesce(auto, false)) THEN false WHEN draft THEN true ELSE c_mktsegment = 'MACHINERY' END AS in_preview FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def detailed_customers(spark: SparkSession, d: str) -> DataFrame:
    """FLT12: an overview and figures must exist; a draft overview shows in a preview alone; else the listing decides."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("overview"), F.bool_or(F.col("o_orderstatus") == "O").alias("auto"), F.bool_and(F.col("o_orderpriority") != "1-URGENT").alias("draft"))
    rows = table(spark, d, "customer").join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    there = F.coalesce("overview", F.lit(False)) & F.coalesce("auto", F.lit(False))
    rule = lambda preview: F.when(~there, False).when(F.col("draft"), preview).otherwise(F.col("c_mktsegment") == "MACHINERY")
    return rows.select("c_custkey", rule(False).alias("detailed"), rule(True).alias("in_preview"))


@query(r"""SELECT page_id, 'S' || CAST(page_id AS VARCHAR) AS id, CAST(len(p) AS BIGINT) AS paragraphs FROM (SELECT page_id, url, regexp_extract_all(html, '<p>[^<]+') AS p FROM pages) WHERE NOT contains(url, '#') AND len(p) > 0""")
def usable_sources(spark: SparkSession, d: str) -> DataFrame:
    """FLT17: sources without a failure (here an anchor) that have paragraphs."""
    p = table(spark, d, "pages").select("page_id", F.when(F.contains("url", F.lit("#")), "anchor").alias("failure"), F.regexp_extract_all("html", F.lit("<p>[^<]+"), F.lit(0)).alias("p"))
    return p.where(F.col("failure").isNull() & (F.size("p") > 0)).select("page_id", F.concat(F.lit("S"), F.col("page_id").cast("string")).alias("id"), F.size("p").cast("bigint").alias("paragraphs"))


@query("""SELECT l_orderkey, 'S' || CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS VARCHAR) AS id, l_partkey FROM lineitem WHERE l_returnflag = 'N'""")
def numbered_sources(spark: SparkSession, d: str) -> DataFrame:
    """FLT19: an entry's approved sources, numbered S1, S2 and so on in their order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", F.concat(F.lit("S"), place.cast("string")).alias("id"), "l_partkey")


@query("SELECT p_partkey AS slug, p_name AS name FROM part WHERE p_size <= 10")
def first_release(spark: SparkSession, d: str) -> DataFrame:
    """FLT18, ADD63: the entries marked for the first release, projected to what a choice needs."""
    return table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"))


@query("""SELECT l_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS segments FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'ECONOMY') GROUP BY 1""")
def core_segments(spark: SparkSession, d: str) -> DataFrame:
    """FLT21: the names of each company's segments of one class, mapped by a fixed table."""
    classes = {"PROMO": "core", "ECONOMY": "core", "SMALL": "partial", "LARGE": "other"}
    kind = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))[F.col("p_type")]
    core = table(spark, d, "part").where(kind == "core").select("p_partkey", "p_type")
    met = table(spark, d, "lineitem").join(core, F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("segments"))  # a class has a handful of names


_REFS = """refs AS (SELECT p_partkey AS page, generate_subscripts(string_split(p_name, ' '), 1) AS place, unnest(string_split(p_name, ' ')) AS ref FROM part), dim(ref, title) AS (VALUES ('red', 'Red'), ('blue', 'Blue'), ('ring', 'Ring'), ('bolt', 'Bolt'))"""


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References of pages (page, at, ref) and the fixed small dimension (ref, title) that they name."""
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.posexplode(words_of()).alias("at", "ref"))
    return refs, spark.createDataFrame([("red", "Red"), ("blue", "Blue"), ("ring", "Ring"), ("bolt", "Bolt")], "ref string, title string")


@query(f"WITH {_REFS} SELECT DISTINCT ref, title, page FROM refs JOIN dim USING (ref)")
def deeper_links(spark: SparkSession, d: str) -> DataFrame:
    """JON12, ADD02, ADD13, GRF07: references inverted: each target with the pages that name it, a row a page."""
    refs, dim = _references(spark, d)
    return refs.join(dim, "ref").select("ref", "title", "page").distinct()


@query(f"WITH {_REFS} SELECT page, string_agg(title, ',' ORDER BY place) AS titles FROM refs JOIN dim USING (ref) GROUP BY 1")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """JON13, ADD05: a page's references in their order, those without a target dropped."""
    refs, dim = _references(spark, d)
    return refs.join(dim, "ref").groupBy("page").agg(ordered_join(F.collect_list(F.struct("at", F.col("title").alias("name")))).alias("titles"))  # one name's words


@query(f"WITH {_REFS} SELECT page, string_agg(coalesce(title, ref), ',' ORDER BY place) AS names FROM refs LEFT JOIN dim USING (ref) GROUP BY 1")
def names_or_slugs(spark: SparkSession, d: str) -> DataFrame:
    """ADD18: names of references in order; one without a name stands for itself."""
    refs, dim = _references(spark, d)
    return refs.join(dim, "ref", "left").groupBy("page").agg(ordered_join(F.collect_list(F.struct("at", F.coalesce("title", "ref").alias("name")))).alias("names"))


@query("SELECT max(coalesce(d, '')) AS latest FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)")
def latest_decision(spark: SparkSession, d: str) -> DataFrame:
    """AGG17: the latest of dates that some rows don't have; an empty text without any."""
    day = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").agg(F.max(F.coalesce(day, F.lit(""))).alias("latest"))


@query("""SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS a, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS r,
concat_ws(',', CASE WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 'A' END, CASE WHEN count(*) FILTER (l_returnflag = 'N') = 0 THEN 'N' END, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'R' END) AS missing FROM lineitem GROUP BY 1""")
def required_sections(spark: SparkSession, d: str) -> DataFrame:
    """AGG24: rows grouped by a fixed list of keys, and the keys that have none: an error if that isn't empty."""
    flag = F.col("l_returnflag")
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*(F.count_if(flag == k).alias(k.lower()) for k in "ANR"))
    return counts.select("*", F.concat_ws(",", *(F.when(F.col(k.lower()) == 0, k) for k in "ANR")).alias("missing"))


@query("""WITH m AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2), l AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY place, l_partkey) AS members FROM m GROUP BY 1),
o AS (SELECT o_custkey, o_orderkey, members, o_orderstatus = 'O' AS target, o_orderdate FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_custkey, coalesce(arg_max(members, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (target AND members IS NOT NULL), arg_max(members, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (NOT target AND members IS NOT NULL)) AS members FROM o GROUP BY 1""")
def latest_members(spark: SparkSession, d: str) -> DataFrame:
    """AGG25: members, distinct in order, of the latest target document that has any, else of the last other one."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"))
    lists = first.groupBy("l_orderkey").agg(ordered_join(F.collect_list(F.struct("at", "l_partkey", F.col("l_partkey").cast("string").alias("name")))).alias("members"))  # one order's lines
    o = table(spark, d, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    has, target, newest = F.col("members").isNotNull(), F.col("o_orderstatus") == "O", F.struct("o_orderdate", "o_orderkey")
    pick = lambda cond: F.max_by(F.when(cond, F.col("members")), F.when(cond, newest))
    return o.groupBy("o_custkey").agg(F.coalesce(pick(has & target), pick(has & ~target)).alias("members"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS fy, o_orderdate, o_orderstatus FROM orders), good AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(y := fy, d := o_orderdate, k := o_orderkey)) AS o_orderkey, max(fy) AS fy FROM o WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), bad AS (SELECT o_custkey, max(fy) AS fy FROM o WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT o_custkey, CASE WHEN bad.fy > good.fy THEN NULL ELSE good.o_orderkey END AS o_orderkey, CASE WHEN good.fy IS NULL THEN 'none' WHEN bad.fy > good.fy THEN 'newer period unusable' END AS error FROM good FULL JOIN bad USING (o_custkey)""")
def latest_report(spark: SparkSession, d: str) -> DataFrame:
    """SRT01: the latest usable report by period, then time; an error if there is none or a newer period can't be used."""
    o = table(spark, d, "orders").withColumn("fy", F.year("o_orderdate"))
    good = F.col("o_orderstatus").isin("F", "O")
    by = o.groupBy("o_custkey").agg(F.max_by(F.when(good, F.col("o_orderkey")), F.when(good, F.struct("fy", "o_orderdate", "o_orderkey"))).alias("best"), F.max(F.when(good, F.col("fy"))).alias("g"), F.max(F.when(~good, F.col("fy"))).alias("b"))
    newer = F.coalesce(F.col("b") > F.col("g"), F.lit(False))
    return by.select("o_custkey", F.when(~newer, F.col("best")).alias("o_orderkey"), F.when(F.col("g").isNull(), "none").when(newer, "newer period unusable").alias("error"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'""")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    """SRT10: the corrections of all items as rows, newest first, exploded from each item's list."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")))).alias("c"))  # one order's lines
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lists.join(done, "l_orderkey").select("l_orderkey", F.explode("c").alias("c")).select("l_orderkey", "c.*").orderBy(F.desc("day"), "l_orderkey")


@query("""SELECT event_id, DATE '2024-01-20' - CAST(ts AS DATE) <= 3 AS is_new FROM events ORDER BY ts DESC, event_id DESC LIMIT 5""")
def front_news(spark: SparkSession, d: str) -> DataFrame:
    """ADD07: the five newest items, and whether each is at most three days old on the build date; later ones are new too."""
    top = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)
    return top.select("event_id", (F.datediff(F.lit("2024-01-20").cast("date"), F.col("ts").cast("date")) <= 3).alias("is_new"))


@query("""SELECT strftime(max(ts), '%Y-%m-%d') AS checked_on FROM (SELECT ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 5)""")
def checked_on(spark: SparkSession, d: str) -> DataFrame:
    """ADD09, SRC33: the latest check date of the events that are shown."""
    shown = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).orderBy("ts", "event_id").limit(5)
    return shown.agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("checked_on"))


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name), n_name) AS k FROM nation)
SELECT r_name, CAST(count(*) AS BIGINT) AS total, string_agg(n_name, ',' ORDER BY n_nationkey) AS units, string_agg(n_name, ',' ORDER BY k) FILTER (k <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || CAST(count(*) - 3 AS VARCHAR) || ' more' ELSE '' END AS short FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY 1""")
def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    """ADD10, ADD11, ADD68: a stage's units in order, their number, its three shortest names and how many more there are."""
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name"))).alias("units"))  # a region's nations
    rows = table(spark, d, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"))
    n = F.size("units")
    by_length = F.slice(F.array_sort(F.transform("units", lambda u: F.struct(F.length(u["name"]).alias("n"), u["name"].alias("name")))), 1, 3)
    more = F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("r_name", n.cast("bigint").alias("total"), ordered_join(F.col("units")).alias("units"), F.concat(F.array_join(F.transform(by_length, lambda u: u["name"]), ","), more).alias("short"))


@query("""WITH s AS (SELECT l_suppkey, p_type, p_size, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_suppkey, array_to_string(list_filter(['PROMO', 'SMALL', 'LARGE'], lambda x: list_contains(list(DISTINCT p_type), x)), ',') AS stages, array_to_string(list_slice(list_transform(list_sort(list(DISTINCT struct_pack(a := p_size, b := p_name))), lambda x: x.b), 1, 2), ',') AS first FROM s GROUP BY 1""")
def company_stages(spark: SparkSession, d: str) -> DataFrame:
    """ADD12, AGG16: each company's stages in a fixed order, and the names of its first two processes."""
    met = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    pairs = met.groupBy("l_suppkey", "p_type", "p_size", "p_name").agg(F.lit(1))
    by = Window.partitionBy("l_suppkey").orderBy("p_size", "p_name")
    first = pairs.select("l_suppkey", "p_size", "p_name").distinct().withColumn("k", F.row_number().over(by)).where("k <= 2").groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]), ",").alias("first"))
    order = F.array(*map(F.lit, ("PROMO", "SMALL", "LARGE")))
    kinds = pairs.groupBy("l_suppkey").agg(F.collect_set("p_type").alias("kinds"))  # a handful of kinds
    return kinds.join(first, "l_suppkey").select("l_suppkey", F.array_join(F.filter(order, lambda x: F.array_contains(F.col("kinds"), x)), ",").alias("stages"), "first")


@query("""WITH w AS (SELECT n_nationkey, n_name, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS a, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) SELECT n_name, concat_ws(',', a, CASE WHEN b IS DISTINCT FROM a THEN b END) AS related FROM w""")
def related_names(spark: SparkSession, d: str) -> DataFrame:
    """ADD16: names of what flows into and out of a unit, distinct in order, by an edge table joined both ways."""
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    edges = R.neighbours(n, ["n_regionkey"], ["n_nationkey"], "n_nationkey").where("next is not null").select(F.col("n_nationkey").alias("src"), F.col("next").alias("dst"))
    name = n.select(F.col("n_nationkey").alias("key"), "n_name")
    before = edges.join(name, F.col("src") == F.col("key")).select(F.col("dst").alias("n_nationkey"), F.struct(F.lit(0).alias("o"), F.col("n_name").alias("name")).alias("x"))
    after = edges.join(name, F.col("dst") == F.col("key")).select(F.col("src").alias("n_nationkey"), F.struct(F.lit(1).alias("o"), F.col("n_name").alias("name")).alias("x"))
    lists = before.unionByName(after).groupBy("n_nationkey").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["name"])).alias("names"))
    return n.join(lists, "n_nationkey", "left").select("n_name", F.coalesce(F.array_join("names", ","), F.lit("")).alias("related"))


@query("""SELECT conv_id, bool_or(contains(lower(text), 'not')) AS has_conflict, CAST(count(*) AS BIGINT) AS claims FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def judged(spark: SparkSession, d: str) -> DataFrame:
    """ADD17: whether any of a judge's claims conflicts, worked out anew from the claims whatever the judge says."""
    conflict = F.contains(F.lower("text"), F.lit("not"))
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.bool_or(conflict).alias("has_conflict"), F.count("*").alias("claims"))


@query("""SELECT o_orderkey, coalesce(c_name, 'order ' || CAST(o_orderkey AS VARCHAR)) AS title, CASE WHEN c_name IS NULL THEN 'made' ELSE 'master' END AS origin FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def made_sources(spark: SparkSession, d: str) -> DataFrame:
    """ADD19: the master's source for a document where there is one, else one made from the document."""
    master = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.struct(F.col("c_name").alias("title"), F.lit("master").alias("origin")).alias("s"))
    rows = table(spark, d, "orders").join(master, F.col("c_custkey") == F.col("o_custkey"), "left")
    made = F.struct(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("made").alias("origin"))
    return rows.select("o_orderkey", F.coalesce("s", made).alias("s")).select("o_orderkey", "s.*")


@query(r"""SELECT o_orderkey, CASE WHEN regexp_matches(m, '^[0-9]{4}-[0-9]{2}$') THEN substr(m, 1, 4) || '/' || CAST(CAST(substr(m, 6, 2) AS INTEGER) AS VARCHAR) ELSE '' END AS label, substr(m0, 1, 4) || ' Q' || CAST((CAST(substr(m0, 6, 2) AS INTEGER) + 2) // 3 AS VARCHAR) AS quarter
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m') END AS m, strftime(o_orderdate, '%Y-%m') AS m0 FROM orders)""")
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    """ADD20, ADD67: a label for a period of the right form, else an empty one; a label for its quarter."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    m = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(month)
    label = F.when(m.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(F.substring(m, 1, 4), F.lit("/"), F.substring(m, 6, 2).try_cast("int").cast("string"))).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"), F.concat(F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey IS NULL THEN 'company' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-') THEN 'shape' END, CASE WHEN year(o_orderdate) < 1993 THEN 'period' END) AS problems, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T00:00:00+09:00' AS announced FROM orders""")
def checked_bundles(spark: SparkSession, d: str) -> DataFrame:
    """ADD21, ADD22, ADD46: what is wrong with an input before it is used, and its announcement at midnight local time."""
    bad = F.concat_ws(",", F.when(F.col("o_custkey").isNull(), "company"), F.when(~F.col("o_orderpriority").rlike("^[1-5]-"), "shape"), F.when(F.year("o_orderdate") < 1993, "period"))
    return table(spark, d, "orders").select("o_orderkey", bad.alias("problems"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00+09:00")).alias("announced"))


@query("""SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, role, text)) AS text_sha FROM conversations GROUP BY 1""")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """ADD23: a document's paragraphs joined in order."""
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))  # one document's paragraphs
    return lists.select("conv_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), 256).alias("text_sha"))


@query("""WITH agents(agent, model) AS (VALUES ('purchase', 'large'), ('click', 'small'), ('view', 'small'), ('error', 'gone')), models(model, price) AS (VALUES ('large', 15), ('small', 3))
SELECT event_id, coalesce(model, '') AS model, CAST(round(CAST(value AS DECIMAL(18,2)) * price / 1000, 6) AS DOUBLE) AS cost, CASE WHEN agents.model IS NULL THEN 'unknown agent' WHEN price IS NULL THEN 'no price' END AS error FROM events LEFT JOIN agents ON agent = event_type LEFT JOIN models USING (model)""")
def priced_usage(spark: SparkSession, d: str) -> DataFrame:
    """ADD24, ADD28: usage by agent, its model and its price, both from fixed small tables; what has none is an error."""
    agents = spark.createDataFrame([("purchase", "large"), ("click", "small"), ("view", "small"), ("error", "gone")], "event_type string, model string")
    models = spark.createDataFrame([("large", 15), ("small", 3)], "model string, price int")
    rows = table(spark, d, "events").join(agents, "event_type", "left").join(models, "model", "left")
    error = F.when(F.col("model").isNull(), "unknown agent").when(F.col("price").isNull(), "no price")
    return rows.select("event_id", F.coalesce("model", F.lit("")).alias("model"), F.round(money("value") * F.col("price") / 1000, 6).cast("double").alias("cost"), error.alias("error"))


@query(r"""SELECT page_id, 'content/' || lower(regexp_extract(url, '/([a-z]{2})/', 1)) || '/' || CAST(page_id AS VARCHAR) || '.md' AS path FROM pages WHERE regexp_matches(url, '/[a-z]{2}/') AND NOT contains(url, '#')""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """ADD30: added and changed Markdown files below given folders, in order; removed ones (here with an anchor) don't count."""
    p = table(spark, d, "pages").where(F.col("url").rlike("/[a-z]{2}/") & ~F.contains("url", F.lit("#")))
    path = F.concat(F.lit("content/"), F.lower(F.regexp_extract("url", "/([a-z]{2})/", 1)), F.lit("/"), F.col("page_id").cast("string"), F.lit(".md"))
    return p.select("page_id", path.alias("path")).orderBy("path")


@query(r"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, 'href="(https?://[^"]+)"', 1) AS links FROM pages)
SELECT page_id, CASE WHEN len(links) > 0 THEN CAST(len(links) AS BIGINT) ELSE 1 END AS n, CASE WHEN len(links) > 0 THEN links[1] ELSE url END AS first, array_to_string(list_sort(list_distinct(list_transform(CASE WHEN len(links) > 0 THEN links ELSE [url] END, lambda u: lower(regexp_replace(u, '/+$', ''))))), ' ') AS listed FROM l""")
def declared_sources(spark: SparkSession, d: str) -> DataFrame:
    """ADD31, ADD34: an item's declared sources, else its own article as the only one; their URLs in lower case without a last slash."""
    links = F.regexp_extract_all("html", F.lit('href="(https?://[^"]+)"'), F.lit(1))
    own = table(spark, d, "pages").select("page_id", F.when(F.size(links) > 0, links).otherwise(F.array("url")).alias("s"))
    listed = F.array_sort(F.array_distinct(F.transform("s", lambda u: F.lower(F.regexp_replace(u, "/+$", "")))))
    return own.select("page_id", F.size("s").cast("bigint").alias("n"), F.element_at("s", 1).alias("first"), F.array_join(listed, " ").alias("listed"))


@query(r"""SELECT conv_id, turn, regexp_extract(text, '(?i)\b(ack|fix|skip)\b', 1) AS command, length(text) > 4000 AS too_long FROM conversations WHERE role = 'user'""")
def parsed_commands(spark: SparkSession, d: str) -> DataFrame:
    """ADD37: a comment's command word, empty if there is none, and whether the comment is over its limit."""
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.regexp_extract("text", r"(?i)\b(ack|fix|skip)\b", 1).alias("command"), (F.length("text") > 4000).alias("too_long"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations""")
def carried_headings(spark: SparkSession, d: str) -> DataFrame:
    """ADD38: rows of a report with the heading that stands above them, carried forward."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(by).alias("heading"))


@query("""WITH t AS (SELECT p_name AS target, count(*) AS n, min(p_partkey) AS one FROM part GROUP BY 1), w AS (SELECT l_suppkey, p_name AS target FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT 0, 'no such name')
SELECT l_suppkey, target, CASE WHEN n = 1 THEN one END AS p_partkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' END AS error FROM w LEFT JOIN t USING (target)""")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """ADD39, ADD42: names resolved to the one row that has them; none or several are an error."""
    part = table(spark, d, "part")
    known = part.groupBy(F.col("p_name").alias("target")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("only"))
    asked = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", F.col("p_name").alias("target")).union(spark.range(1).select(F.lit(0).cast("bigint"), F.lit("no such name"))).distinct()
    error = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous")
    return asked.join(known, "target", "left").select("l_suppkey", "target", F.when(F.col("n") == 1, F.col("only")).alias("p_partkey"), error.alias("error"))


@query("""SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) FILTER (event_type = 'purchase') AS version FROM events GROUP BY 1""")
def last_versions(spark: SparkSession, d: str) -> DataFrame:
    """ADD40: the last entry of a log that matches, null without any."""
    hit = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.when(hit, F.col("event_id")), F.when(hit, F.struct("ts", "event_id"))).alias("version"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'env' END, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'post_check' END, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'rolled_back_to' END) AS missing FROM orders""")
def deploy_records(spark: SparkSession, d: str) -> DataFrame:
    """ADD41, ADD43: fields that a record must have, some of them depending on others; the names of those that fail."""
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", F.when(~s.isin("F", "O"), "env"), F.when((s == "F") & (F.col("o_totalprice") < 50000), "post_check"), F.when((s == "O") & (F.col("o_orderpriority") == "1-URGENT"), "rolled_back_to")).alias("missing"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')"


@query(rf"SELECT DISTINCT host FROM (SELECT {_HOST} AS host FROM pages UNION ALL SELECT unnest(['example.com', 'a.example']))")
def allowed_hosts(spark: SparkSession, d: str) -> DataFrame:
    """ADD45: hosts that are allowed by list, and those of one's own pages."""
    from sorrel.functions import scalars as S

    listed = spark.createDataFrame([("example.com",), ("a.example",)], "host string")
    return table(spark, d, "pages").select(S.host_key(F.col("url")).alias("host")).unionByName(listed).distinct()


@query(rf"""SELECT host, CAST(count(*) AS BIGINT) AS n, max(page_id) AS newest, CASE WHEN bool_or(contains(html, '<p>')) THEN 'ok' ELSE 'no items' END AS status FROM (SELECT {_HOST} AS host, page_id, html FROM pages) GROUP BY 1""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    """ADD53, ADD32: a line for each source: its items, the newest one, its state."""
    from sorrel.functions import scalars as S

    p = table(spark, d, "pages").withColumn("host", S.host_key(F.col("url")))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.max("page_id").alias("newest"), F.when(F.bool_or(F.contains("html", F.lit("<p>"))), "ok").otherwise("no items").alias("status"))


@query(r"""SELECT page_id, sha256(html) AS sha, CASE WHEN regexp_matches(html, '(?i)<html') THEN 'html' ELSE 'text' END AS format, CASE WHEN len(p) > 0 THEN CAST(len(p) AS BIGINT) END AS paragraphs, CASE WHEN len(p) = 0 THEN 'no paragraphs' END AS failure FROM (SELECT *, regexp_extract_all(html, '<p>[^<]+') AS p FROM pages)""")
def collected_sources(spark: SparkSession, d: str) -> DataFrame:
    """ADD51: a row for each source with the digest of its bytes, its format, and paragraphs or a failure."""
    p = table(spark, d, "pages").withColumn("p", F.regexp_extract_all("html", F.lit("<p>[^<]+"), F.lit(0)))
    n = F.size("p")
    return p.select("page_id", F.sha2("html", 256).alias("sha"), F.when(F.col("html").rlike("(?i)<html"), "html").otherwise("text").alias("format"), F.when(n > 0, n.cast("bigint")).alias("paragraphs"), F.when(n == 0, "no paragraphs").alias("failure"))


@query("""SELECT event_id, src FROM (SELECT event_id, 'ranked' AS src FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'observed' FROM events WHERE event_type = 'view') WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)""")
def found_candidates(spark: SparkSession, d: str) -> DataFrame:
    """ADD54: candidates by id among the ranked and the observed ones."""
    e = table(spark, d, "events")
    both = e.where("event_type = 'purchase'").select("event_id", F.lit("ranked").alias("src")).unionByName(e.where("event_type = 'view'").select("event_id", F.lit("observed").alias("src")))
    return both.join(e.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("event_id"), "event_id", "left_semi")


@query("""SELECT c_custkey AS slug, c_name AS name, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR END AS code, c_mktsegment = 'MACHINERY' AS listed FROM customer WHERE length(c_name) >= 2""")
def listed_companies(spark: SparkSession, d: str) -> DataFrame:
    """ADD55, ADD64: companies with their optional fields, for a list of names."""
    return table(spark, d, "customer").where(F.length("c_name") >= 2).select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, money("c_acctbal").cast("string")).alias("code"), (F.col("c_mktsegment") == "MACHINERY").alias("listed"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'A' WHEN 'click' THEN 'B' ELSE 'C' END AS reliability, to_json(struct_pack(id := event_id, kind := event_type)) AS payload FROM events""")
def front_matters(spark: SparkSession, d: str) -> DataFrame:
    """ADD56, INC29: reliability worked out from the kind by a fixed table, and each row's payload as JSON."""
    kinds = F.create_map(F.lit("purchase"), F.lit("A"), F.lit("click"), F.lit("B"))
    return table(spark, d, "events").select("event_id", F.coalesce(kinds[F.col("event_type")], F.lit("C")).alias("reliability"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("payload"))


@query("""SELECT o_orderkey, error, concat_ws(' / ', CAST(o_orderkey AS VARCHAR), coalesce(name, '-'), coalesce(error, 'ok')) AS detail FROM (SELECT o_orderkey, c_name AS name, CASE WHEN o_orderstatus = 'P' THEN 'transient' WHEN c_custkey IS NULL THEN 'code_mismatch' WHEN o_totalprice < 20000 THEN 'zip_format' WHEN year(o_orderdate) < 1993 THEN 'extract_failed' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)""")
def fetch_errors(spark: SparkSession, d: str) -> DataFrame:
    """ADD58, ADD61: the first stage at which a document failed, and a line of detail with placeholders."""
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    rows = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    error = F.when(F.col("o_orderstatus") == "P", "transient").when(F.col("c_custkey").isNull(), "code_mismatch").when(F.col("o_totalprice") < 20000, "zip_format").when(F.year("o_orderdate") < 1993, "extract_failed")
    return rows.select("o_orderkey", error.alias("error"), F.concat_ws(" / ", F.col("o_orderkey").cast("string"), F.coalesce("c_name", F.lit("-")), F.coalesce(error, F.lit("ok"))).alias("detail"))


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN NULL WHEN s_nationkey <> c_nationkey THEN NULL ELSE n END AS existing, CASE WHEN n IS NOT NULL AND s_nationkey <> c_nationkey THEN 'code differs' END AS skip FROM customer LEFT JOIN (SELECT s_suppkey, s_name AS n, s_nationkey FROM supplier) ON s_suppkey = c_custkey""")
def existing_states(spark: SparkSession, d: str) -> DataFrame:
    """ADD60: the state that exists for a key, none, or why it can't be used."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("n"), "s_nationkey")
    rows = table(spark, d, "customer").join(s, F.col("s_suppkey") == F.col("c_custkey"), "left")
    bad = F.col("n").isNotNull() & (F.col("s_nationkey") != F.col("c_nationkey"))
    return rows.select("c_custkey", F.when(~bad, F.col("n")).alias("existing"), F.when(bad, "code differs").alias("skip"))


@query(f"""WITH {_YEARLY} SELECT o_custkey, CAST(fy AS BIGINT) AS fy, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS operating, CASE WHEN sales > 0 THEN floor(CAST(profit AS DOUBLE) / CAST(sales AS DOUBLE) * 1000 + 0.5) / 10 END AS margin, CAST(coalesce(CASE WHEN n_orders > 1 THEN n_orders END, 1) AS BIGINT) AS staff FROM yearly""")
def chart_series(spark: SparkSession, d: str) -> DataFrame:
    """GRF03, GRF04, GRF05, ADD66: a chart's series by period: two amounts, the margin (halves upwards, also below zero), the consolidated number of staff else the single one."""
    y = yearly(spark, d)
    margin = F.when(F.col("sales") > 0, F.floor(F.col("profit").cast("double") / F.col("sales").cast("double") * 1000 + 0.5) / 10)
    return y.select("o_custkey", F.col("fy").cast("bigint").alias("fy"), F.col("sales").cast("double").alias("sales"), F.col("profit").cast("double").alias("operating"), margin.alias("margin"), F.coalesce(F.when(F.col("n_orders") > 1, F.col("n_orders")), F.lit(1)).cast("bigint").alias("staff"))


@query("""WITH p AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS fy FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS fy, quarter(o_orderdate) AS quarter FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, quarter IN (1, 3) OR p.fy IS NULL AS behind FROM q LEFT JOIN p ON p.o_custkey = q.o_custkey AND p.fy = q.fy""")
def charts_behind(spark: SparkSession, d: str) -> DataFrame:
    """DAT08: a note is ahead of the chart in the first and third quarter, and where its period has no figures yet."""
    o = table(spark, d, "orders").withColumn("fy", F.year("o_orderdate"))
    p = o.where("o_orderstatus = 'F'").select("o_custkey", "fy").distinct().withColumn("there", F.lit(True))
    return o.where("o_orderstatus = 'O'").join(p, ["o_custkey", "fy"], "left").select("o_orderkey", (F.quarter("o_orderdate").isin(1, 3) | F.col("there").isNull()).alias("behind"))


@query(r"""SELECT page_id, regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+$') AS removable FROM pages""")
def removable_paths(spark: SparkSession, d: str) -> DataFrame:
    """NST04: paths that may lose their value, by a pattern."""
    return table(spark, d, "pages").select("page_id", F.col("url").rlike("^https?://[^/]+/[a-z]{2}/[0-9]+$").alias("removable"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m'), o_orderdate, o_orderkey) - 1 AS BIGINT) AS position, '/financials/' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m'), o_orderdate, o_orderkey) - 1 AS VARCHAR) || '/net_sales/value' AS pointer FROM orders""")
def row_pointers(spark: SparkSession, d: str) -> DataFrame:
    """WIN09, INC16, SRT11, NST03: rows in the order of their period; a pointer is made from the place on reading, so an inserted row shifts none that is stored."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.date_format("o_orderdate", "yyyy-MM"), "o_orderdate", "o_orderkey")) - 1
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", place.cast("bigint").alias("position"), F.concat(F.lit("/financials/"), place.cast("string"), F.lit("/net_sales/value")).alias("pointer"))


@query("""SELECT c_custkey, CASE WHEN x.seg IS NULL THEN 'sales,profit' ELSE array_to_string(list_filter(['sales', 'profit'], lambda i: i <> x.item), ',') END AS expected FROM customer LEFT JOIN (VALUES ('MACHINERY', 'profit'), ('HOUSEHOLD', 'sales')) x(seg, item) ON x.seg = c_mktsegment""")
def expected_items(spark: SparkSession, d: str) -> DataFrame:
    """JON01: items to look for, without those that a company is known not to report (a fixed small table)."""
    absent = spark.createDataFrame([("MACHINERY", "profit"), ("HOUSEHOLD", "sales")], "c_mktsegment string, item string")
    rows = table(spark, d, "customer").join(absent, "c_mktsegment", "left")
    return rows.select("c_custkey", F.array_join(F.array_except(F.array(F.lit("sales"), F.lit("profit")), F.array("item")), ",").alias("expected"))
