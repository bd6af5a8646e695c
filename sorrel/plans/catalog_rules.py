"""The rules of a catalog and of generated texts, each group of rules one query: file, key, rule, severity of what fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.operators import rules as Q
from sorrel.plans.registry import query
from sorrel.session import dealt
from sorrel.sources.tables import table


def _sql(*rules: tuple[str, str, str, str, str]) -> str:
    """SQL of rules (file, key, rule, severity, the rows that fail it: FROM and WHERE)."""
    return " UNION ALL ".join(f"SELECT '{file}' AS file, CAST({key} AS VARCHAR) AS key, '{rule}' AS rule, '{severity}' AS severity FROM {rows}" for file, key, rule, severity, rows in rules)


_PARITY = "(SELECT r_name AS v FROM region EXCEPT SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'MARS']))"


@query(_sql(
    ("nation", "n_name", "repeated name", "error", "(SELECT n_name FROM nation GROUP BY 1 HAVING count(*) > 1)"),
    ("nation", "n_regionkey", "unknown stage", "error", "nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')"),
    ("region", "v", "not in enumeration", "error", _PARITY),
    ("region", "v", "not in data", "error", "(SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'MARS']) AS v EXCEPT SELECT r_name FROM region)"),
))
def supply_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ02: repeated names, stages that aren't there (here one is left out), an enumeration against the data both ways."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    enum, own = spark.createDataFrame([("AFRICA",), ("AMERICA",), ("ASIA",), ("MARS",)], "v string"), r.select(F.col("r_name").alias("v"))
    side = lambda df, rule: df.select(F.lit("region").alias("file"), F.col("v").alias("key"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"))
    return Q.all_problems(Q.repeated(n, F.col("n_name"), "nation", "repeated name"), Q.missing_targets(n, "n_regionkey", r.where("r_name <> 'ASIA'"), "r_regionkey", "nation", "unknown stage"), side(own.subtract(enum), "not in enumeration"), side(enum.subtract(own), "not in data"))


@query(_sql(
    ("customer", "c_custkey", "name differs from key", "error", "customer WHERE c_name <> 'Customer#' || lpad(CAST(c_custkey + CASE WHEN c_custkey % 100 = 0 THEN 1 ELSE 0 END AS VARCHAR), 9, '0')"),
    ("customer", "c_name", "repeated name", "error", "(SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)"),
    ("customer", "c_nationkey", "unknown nation", "error", "customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_name NOT LIKE '%5%')"),
    ("customer", "c_custkey", "unknown category", "error", "customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE')"),
))
def company_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ03: names that must follow from the key, repeated names, references to nations and categories."""
    c = table(spark, d, "customer")
    want = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + F.when(F.col("c_custkey") % 100 == 0, 1).otherwise(0)).cast("string"), 9, "0"))
    own = Q.row_rules(c, "customer", F.col("c_custkey"), [("name differs from key", F.col("c_name") != want, "error"), ("unknown category", ~F.col("c_mktsegment").isin("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"), "error")])
    nations = table(spark, d, "nation").where(~F.col("n_name").contains("5"))
    return Q.all_problems(own, Q.repeated(c, F.col("c_name"), "customer", "repeated name"), Q.missing_targets(c, "c_nationkey", nations, "n_nationkey", "customer", "unknown nation"))


@query(_sql(
    ("map", "s_suppkey || '/' || kind", "member not observed", "error", "(SELECT s_suppkey, kind FROM supplier, (SELECT unnest(['PROMO', 'SMALL', 'STANDARD', 'NONE']) AS kind) EXCEPT SELECT l_suppkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey)"),
    ("map", "p_brand || '/' || p_name", "repeated member", "warning", "(SELECT p_brand, p_name FROM part GROUP BY 1, 2 HAVING count(*) > 1)"),
))
def segment_map_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ04: a map's members must be among those observed, and stand once."""
    mapped = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, ("PROMO", "SMALL", "STANDARD", "NONE")))).alias("kind"))
    seen = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), F.col("p_type").alias("kind")).distinct()
    missing = mapped.join(seen, ["s_suppkey", "kind"], "left_anti").select(F.lit("map").alias("file"), F.concat_ws("/", F.col("s_suppkey").cast("string"), "kind").alias("key"), F.lit("member not observed").alias("rule"), F.lit("error").alias("severity"))
    return Q.all_problems(missing, Q.repeated(table(spark, d, "part"), F.concat_ws("/", "p_brand", "p_name"), "map", "repeated member", "warning"))


@query(_sql(
    ("overview", "doc_id", "no heading", "error", "documents WHERE NOT contains(text, chr(10))"),
    ("overview", "doc_id", "cites nothing", "error", "documents WHERE NOT regexp_matches(text, '[0-9]{4}')"),
    ("overview", "doc_id", "under 300 characters", "warning", "documents WHERE length(regexp_replace(text, '[ \t\n]+', '', 'g')) < 300"),
    ("overview", "doc_id", "over 500 characters", "warning", "documents WHERE length(regexp_replace(text, '[ \t\n]+', '', 'g')) > 500"),
    ("overview", "doc_id", "unknown source", "error", "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
))
def overview_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ05: headings, citations (here a year) and 300 to 500 visible characters; sources that aren't listed."""
    docs, t = table(spark, d, "documents"), F.col("text")
    n = F.length(F.regexp_replace(t, "[ \t\n]+", ""))
    own = Q.row_rules(docs, "overview", F.col("doc_id"), [("no heading", ~F.contains(t, F.lit("\n")), "error"), ("cites nothing", ~t.rlike("[0-9]{4}"), "error"), ("under 300 characters", n < 300, "warning"), ("over 500 characters", n > 500, "warning")])
    return Q.all_problems(own, Q.missing_targets(docs, "doc_id", table(spark, d, "labels"), "doc_id", "overview", "unknown source"))


@query(_sql(
    ("sources", "page_id", "not https", "error", "pages WHERE NOT regexp_matches(url, '^https://')"),
    ("sources", "page_id", "host not listed", "error", r"pages WHERE regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') NOT IN ('example.com')"),
    ("sources", "url", "repeated address", "error", "(SELECT lower(url) AS url FROM pages GROUP BY 1 HAVING count(*) > 1)"),
    ("sources", "page_id", "tracking parameter", "warning", "pages WHERE contains(url, 'utm_')"),
))
def source_config_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ06: addresses of sources: scheme, host by list, no repeats, no tracking."""
    p, u = table(spark, d, "pages"), F.col("url")
    own = Q.row_rules(p, "sources", F.col("page_id"), [("not https", ~u.rlike("^https://"), "error"), ("host not listed", ~S.host_key(u).isin("example.com"), "error"), ("tracking parameter", F.contains(u, F.lit("utm_")), "warning")])
    return Q.all_problems(own, Q.repeated(p, F.lower("url"), "sources", "repeated address"))


_TURNS = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations"


@query(_sql(
    ("body", "conv_id || '/' || turn", "wrong first level", "error", f"({_TURNS}) WHERE k = 1 AND role <> 'system'"),
    ("body", "conv_id || '/' || turn", "level repeats", "error", f"({_TURNS}) WHERE before = role"),
    ("body", "conv_id", "supplementary only", "warning", "(SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_and(role <> 'assistant'))"),
))
def body_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ07: levels of a body's parts in order, and bodies that rest on supplementary parts alone."""
    c = table(spark, d, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = c.withColumn("k", F.row_number().over(by)).withColumn("before", F.lag("role").over(by))
    own = Q.row_rules(rows, "body", F.concat_ws("/", "conv_id", "turn"), [("wrong first level", (F.col("k") == 1) & (F.col("role") != "system"), "error"), ("level repeats", F.col("before") == F.col("role"), "error")])
    only = c.groupBy("conv_id").agg(F.bool_and(F.col("role") != "assistant").alias("only")).where("only")
    return Q.all_problems(own, only.select(F.lit("body").alias("file"), F.col("conv_id").cast("string").alias("key"), F.lit("supplementary only").alias("rule"), F.lit("warning").alias("severity")))


@query(_sql(
    ("reviewed", "item_id", "digits", "error", "benchmark WHERE regexp_matches(text, '[0-9]')"),
    ("reviewed", "item_id", "citation", "error", r"benchmark WHERE regexp_matches(text, '\[S[0-9]+\]')"),
    ("reviewed", "item_id", "names a company", "error", "benchmark WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'copyright')"),
    ("reviewed", "item_id", "short", "warning", "benchmark WHERE length(text) < 200"),
))
def reviewed_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ08, DQ25: reviewed texts hold no digits, citations or names of a list, and aren't short."""
    t = F.col("text")
    named = F.exists(F.array(F.lit("licensed"), F.lit("copyright")), lambda w: F.contains(F.lower(t), w))
    return Q.row_rules(table(spark, d, "benchmark"), "reviewed", F.col("item_id"), [("digits", t.rlike("[0-9]"), "error"), ("citation", t.rlike(r"\[S[0-9]+\]"), "error"), ("names a company", named, "error"), ("short", F.length(t) < 200, "warning")])


@query(_sql(
    ("terms", "p_partkey", "refers to itself", "error", "part WHERE string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2]"),
    ("terms", "p_partkey || '/' || ref", "unknown term", "error", "(SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS ref FROM part) WHERE ref NOT IN ('red', 'blue', 'green', 'small', 'large', 'ring', 'bolt', 'widget')"),
    ("terms", "name", "repeated name", "error", "(SELECT lower(p_name) AS name FROM part GROUP BY 1 HAVING count(*) > 1)"),
))
def term_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ09: references of terms to themselves and to terms that aren't there, names that stand twice."""
    p = table(spark, d, "part")
    w = F.split("p_name", " ")
    own = Q.row_rules(p, "terms", F.col("p_partkey"), [("refers to itself", F.element_at(w, 1) == F.try_element_at(w, F.lit(2)), "error")])
    refs = p.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("ref"))
    unknown = Q.row_rules(refs, "terms", F.concat_ws("/", F.col("p_partkey").cast("string"), "ref"), [("unknown term", ~F.col("ref").isin("red", "blue", "green", "small", "large", "ring", "bolt", "widget"), "error")])
    return Q.all_problems(own, unknown, Q.repeated(p, F.lower("p_name"), "terms", "repeated name"))


@query(_sql(
    ("process", "l_orderkey || '/' || l_linenumber", "unknown part", "error", "lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)"),
    ("process", "l_orderkey || '/' || l_linenumber", "unknown supplier", "error", "lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > -500)"),
    ("process", "o_orderkey", "no parts", "warning", "orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    ("process", "l_orderkey", "over six parts", "warning", "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 6)"),
))
def process_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ10: references of process pages, and pages with no parts or too many."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    out = lambda df, k, rule, sev: df.select(F.lit("process").alias("file"), k.cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(sev).alias("severity"))
    parts = li.join(table(spark, d, "part").where("p_size > 1").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    makers = li.join(table(spark, d, "supplier").where("s_acctbal > -500").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_anti")
    empty = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")
    many = li.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 6")
    return Q.all_problems(out(parts, key, "unknown part", "error"), out(makers, key, "unknown supplier", "error"), out(empty, F.col("o_orderkey"), "no parts", "warning"), out(many, F.col("l_orderkey"), "over six parts", "warning"))


@query(_sql(
    ("quiz", "conv_id", "questions differ from answers", "error", "(SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') <> count(*) FILTER (role = 'assistant'))"),
    ("quiz", "conv_id", "under two questions", "warning", "(SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') < 2)"),
    ("quiz", "conv_id || '/' || turn", "empty choice", "error", "conversations WHERE trim(text) = ''"),
    ("quiz", "conv_id || '/' || turn", "repeated choice", "error", "(SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id, text HAVING count(*) > 1)"),
))
def quiz_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ11: a quiz has as many answers as questions, two questions at least, no empty or repeated choices."""
    c = table(spark, d, "conversations")
    by = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("q"), F.count_if(F.col("role") == "assistant").alias("a"))
    whole = Q.row_rules(by, "quiz", F.col("conv_id"), [("questions differ from answers", F.col("q") != F.col("a"), "error"), ("under two questions", F.col("q") < 2, "warning")])
    key = F.concat_ws("/", "conv_id", "turn")
    again = c.groupBy("conv_id", "text").agg(F.max("turn").alias("turn"), F.count("*").alias("n"))
    return Q.all_problems(whole, Q.row_rules(c, "quiz", key, [("empty choice", F.trim("text") == "", "error")]), Q.row_rules(again, "quiz", key, [("repeated choice", F.col("n") > 1, "error")]))


@query(_sql(
    ("learn", "path", "repeated path", "error", "(SELECT r_name || '/' || n_name AS path FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 1)"),
    ("learn", "n_name", "tier without page", "error", "nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    ("learn", "r_name", "tier too small", "warning", "region WHERE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 4) < 5"),
    ("learn", "n_name", "figure missing", "error", "nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"),
))
def learn_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ12: a learning path: unique places, pages and figures that exist, tiers of a least size."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    out = lambda df, k, rule, sev: df.select(F.lit("learn").alias("file"), F.col(k).alias("key"), F.lit(rule).alias("rule"), F.lit(sev).alias("severity"))
    pages = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    figures = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    sizes = r.join(n.where("n_nationkey > 4").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("k")), "r_regionkey", "left").where(F.coalesce("k", F.lit(0)) < 5)
    return Q.all_problems(Q.repeated(both, F.concat_ws("/", "r_name", "n_name"), "learn", "repeated path"), out(n.join(pages, "n_nationkey", "left_anti"), "n_name", "tier without page", "error"), out(sizes, "r_name", "tier too small", "warning"), out(n.join(figures, "n_nationkey", "left_anti"), "n_name", "figure missing", "error"))


@query(_sql(
    ("notes", "page_id", "wrong name", "error", "pages WHERE NOT regexp_matches(url, '/[a-z]{2}/[0-9]+([?#].*)?$')"),
    ("notes", "page_id", "domain not allowed", "error", r"pages WHERE NOT regexp_matches(lower(url), '^https?://([a-z0-9-]+\.)*example\.com([/?#]|$)')"),
    ("notes", "page_id", "period unknown", "error", "pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE length(text) > 1000)"),
    ("notes", "page_id", "text too long", "warning", "pages WHERE length(html) > 5000"),
))
def note_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ13: notes on periods: name, allowed domains, a period that exists, length."""
    p, u = table(spark, d, "pages"), F.col("url")
    own = Q.row_rules(p, "notes", F.col("page_id"), [("wrong name", ~u.rlike("/[a-z]{2}/[0-9]+([?#].*)?$"), "error"), ("domain not allowed", ~S.domain_allowed(F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1)), ["example.com"]), "error"), ("text too long", F.length("html") > 5000, "warning")])
    return Q.all_problems(own, Q.missing_targets(p, "page_id", table(spark, d, "documents").where(F.length("text") > 1000), "doc_id", "notes", "period unknown"))


@query(_sql(
    ("events", "user_id || '/' || event_type || '/' || day", "repeated event", "error", "(SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1)"),
    ("events", "l_orderkey || '/' || l_linenumber", "ends before it starts", "error", "lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)"),
    ("events", "o_orderkey", "check again", "warning", "orders WHERE DATE '1998-08-01' >= CAST(o_orderdate AS DATE) - 90 AND CAST(o_orderdate AS DATE) >= DATE '1998-06-01'"),
))
def event_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ14: events that stand twice, dates in the wrong order, and those within 90 days of the build date."""
    e = table(spark, d, "events")
    lines = table(spark, d, "lineitem")
    n = lines.count()  # by the files' footers
    dated = dealt(lines, "l_orderkey", n).join(dealt(table(spark, d, "orders"), "o_orderkey", n), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.concat_ws("/", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd"))
    order = Q.row_rules(dated, "events", F.concat_ws("/", "l_orderkey", "l_linenumber"), [("ends before it starts", F.col("l_shipdate").cast("date") < F.col("o_orderdate").cast("date"), "error")])
    day = F.col("o_orderdate").cast("date")
    soon = Q.row_rules(table(spark, d, "orders"), "events", F.col("o_orderkey"), [("check again", (F.lit("1998-08-01").cast("date") >= F.date_sub(day, 90)) & (day >= F.lit("1998-06-01").cast("date")), "warning")])
    return Q.all_problems(Q.repeated(e, key, "events", "repeated event"), order, soon)


@query(_sql(
    ("themes", "l_orderkey || '/' || l_partkey", "repeated company", "error", "(SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)"),
    ("themes", "l_orderkey", "over five others", "error", "(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 HAVING count(*) > 5)"),
    ("themes", "l_orderkey || '/' || l_linenumber", "no basis", "error", "lineitem WHERE l_discount = 0 AND l_tax = 0"),
    ("themes", "p_partkey", "heading too long", "warning", "part WHERE length(p_name) > 12"),
))
def theme_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ15: themes: companies that stand twice, too many others, entries without a basis, long headings."""
    li = table(spark, d, "lineitem")
    many = li.where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return Q.all_problems(
        Q.repeated(li, F.concat_ws("/", "l_orderkey", "l_partkey"), "themes", "repeated company"),
        Q.row_rules(many, "themes", F.col("l_orderkey"), [("over five others", F.col("n") > 5, "error")]),
        Q.row_rules(li, "themes", F.concat_ws("/", "l_orderkey", "l_linenumber"), [("no basis", (F.col("l_discount") == 0) & (F.col("l_tax") == 0), "error")]),
        Q.row_rules(table(spark, d, "part"), "themes", F.col("p_partkey"), [("heading too long", F.length("p_name") > 12, "warning")]),
    )


@query(_sql(
    ("news", "conv_id || '/' || turn", "over 140 characters", "error", r"conversations WHERE role = 'assistant' AND length(regexp_replace(text, 'https?://[^\s]+', repeat('x', 23), 'g')) > 140"),
    ("news", "conv_id || '/' || turn", "over two tags", "error", r"conversations WHERE role = 'assistant' AND len(regexp_extract_all(regexp_replace(text, 'https?://[^\s]+', '', 'g'), '#[A-Za-z0-9_]+')) > 2"),
    ("news", "event_id", "from the future", "error", "events WHERE CAST(ts AS DATE) > DATE '2024-01-25'"),
    ("news", "o_orderkey", "unknown company", "error", "orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900)"),
    ("news", "o_orderkey", "no reason", "warning", "orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O'"),
))
def news_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ16: news: length with short links, tags, dates, companies, reasons."""
    post, o = table(spark, d, "conversations").where("role = 'assistant'"), table(spark, d, "orders")
    tags = F.regexp_count(F.regexp_replace("text", r"https?://[^\s]+", ""), F.lit("#[A-Za-z0-9_]+"))
    known = table(spark, d, "customer").where("c_acctbal > -900").select(F.col("c_custkey").alias("o_custkey"))
    out = lambda df, k, rule, sev: df.select(F.lit("news").alias("file"), F.col(k).cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(sev).alias("severity"))
    return Q.all_problems(
        Q.row_rules(post, "news", F.concat_ws("/", "conv_id", "turn"), [("over 140 characters", S.post_length(F.col("text")) > 140, "error"), ("over two tags", tags > 2, "error")]),
        Q.row_rules(table(spark, d, "events"), "news", F.col("event_id"), [("from the future", F.col("ts").cast("date") > F.lit("2024-01-25").cast("date"), "error")]),
        out(o.join(known, "o_custkey", "left_anti"), "o_orderkey", "unknown company", "error"),
        Q.row_rules(o, "news", F.col("o_orderkey"), [("no reason", (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "O"), "warning")]),
    )


@query(_sql(
    ("config", "user_id", "least over most", "error", "(SELECT user_id FROM events GROUP BY 1 HAVING min(value) * 2 > max(value))"),
    ("config", "event_id", "repeated id", "error", "(SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)"),
    ("config", "user_id", "unknown company", "error", "events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 5)"),
))
def config_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ17: a configuration's ranges, ids and references."""
    e = table(spark, d, "events")
    span = e.groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return Q.all_problems(Q.row_rules(span, "config", F.col("user_id"), [("least over most", F.col("a") * 2 > F.col("b"), "error")]), Q.repeated(e, F.col("event_id"), "config", "repeated id"), Q.missing_targets(e, "user_id", table(spark, d, "customer").where("c_custkey > 5"), "c_custkey", "config", "unknown company"))


@query(_sql(
    ("output", "doc_id", "unknown member", "error", "documents WHERE lang NOT IN ('en', 'de')"),
    ("output", "doc_id", "cites nothing", "error", "documents WHERE NOT contains(text, '.')"),
    ("output", "doc_id", "over two tags", "error", "documents WHERE len(regexp_extract_all(text, '#[A-Za-z0-9_]+')) > 2"),
    ("output", "doc_id", "link in text", "error", "documents WHERE regexp_matches(text, 'https?://')"),
    ("output", "doc_id", "banned word", "error", "documents WHERE contains(lower(replace(lower(text), 'the best', '')), 'best')"),
))
def generated_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ21, DQ22, DQ23, STR29: generated texts: members of a list, citations, tags, links, banned words outside allowed ones. Reprints are `reprinted_items`."""
    t = F.col("text")
    return Q.row_rules(table(spark, d, "documents"), "output", F.col("doc_id"), [
        ("unknown member", ~F.col("lang").isin("en", "de"), "error"),
        ("cites nothing", ~F.contains(t, F.lit(".")), "error"),
        ("over two tags", F.regexp_count(t, F.lit("#[A-Za-z0-9_]+")) > 2, "error"),
        ("link in text", t.rlike("https?://"), "error"),
        ("banned word", F.contains(F.replace(F.lower(t), F.lit("the best"), F.lit("")), F.lit("best")), "error"),
    ])
