"""Further rules and forms: schemas as predicates, YAML pitfalls, canonical JSON, line differences, ranges of dates, gates."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.functions import markup as M
from sorrel.functions import scalars as S
from sorrel.operators import rules as Q
from sorrel.plans.metrics import money
from sorrel.plans.registry import query
from sorrel.session import new_folder
from sorrel.sources.tables import table

#: A schema of orders, in the form of JSON Schema.
ORDER_SCHEMA = {
    "type": "object",
    "required": ["status", "customer"],
    "properties": {
        "status": {"type": "string", "enum": ["F", "O"]},
        "priority": {"type": "string", "pattern": "^[1-5]-[A-Z]+$", "maxLength": 10},
        "customer": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "balance": {"type": "number", "minimum": 0, "maximum": 9000}}},
    },
}


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, c_custkey, c_name AS n, c_acctbal AS b FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > -500) ON c_custkey = o_custkey),
v AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN b < 0 THEN 'customer.balance: minimum' END, CASE WHEN b > 9000 THEN 'customer.balance: maximum' END, CASE WHEN n IS NULL THEN 'customer.name: required' END, CASE WHEN c_custkey IS NULL THEN 'customer: required' END, CASE WHEN NOT regexp_matches(p, '^[1-5]-[A-Z]+$') THEN 'priority: pattern' END, CASE WHEN length(p) > 10 THEN 'priority: maxLength' END, CASE WHEN s NOT IN ('F', 'O') THEN 'status: enum' END], lambda x: x IS NOT NULL)) AS rule FROM r)
SELECT CAST(o_orderkey AS VARCHAR) AS key, rule FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rule) AS k FROM v) WHERE k <= 10""")
def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ18, ADD27, ADD59, NST06: a JSON Schema as predicates over nested rows; each document's first ten violations by path."""
    c = table(spark, d, "customer").where("c_acctbal > -500").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("customer"))
    rows = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "customer")
    found = Q.row_rules(rows, "orders", F.col("o_orderkey"), Q.schema_rules(ORDER_SCHEMA))
    return found.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("rule"))).where("k <= 10").select("key", "rule")


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'F' THEN '/filed_on: unquoted date' END, CASE WHEN o_orderstatus = 'O' THEN '/listed: yes or no' END, CASE WHEN o_orderkey % 3 = 0 THEN '/source/checked: unquoted date' END], lambda x: x IS NOT NULL)) AS problem FROM orders""")
def yaml_pitfalls(spark: SparkSession, d: str) -> DataFrame:
    """SRC21: plain YAML read line by line: dates without quotes and old forms of true and false, with the pointer to them."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    status, quote = F.col("o_orderstatus"), lambda cond, v: F.when(cond, v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    text = F.concat(F.lit("filed_on: "), quote(status == "F", day), F.lit("\nlisted: "), F.when(status == "O", "yes").otherwise("true"), F.lit("\nsource:\n  checked: "), quote(F.col("o_orderkey") % 3 == 0, day), F.lit("\n  note: \"no: yes\"\n"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^ *[a-z_]+:"))
    indexed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.length(F.regexp_extract(x, "^( *)", 1)).alias("depth"), F.regexp_extract(x, "^ *([a-z_]+):", 1).alias("name"), F.regexp_extract(x, "^ *[a-z_]+: *(.*)$", 1).alias("value")))
    rows = table(spark, d, "orders").select("o_orderkey", indexed.alias("l")).select("o_orderkey", "l", F.explode("l").alias("x"))
    parent = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("l", lambda y: (y["depth"] < F.col("x.depth")) & (y["i"] < F.col("x.i"))), lambda y: y["name"])), -1)
    pointer = F.concat(F.when(parent != "", F.concat(F.lit("/"), parent)).otherwise(""), F.lit("/"), F.col("x.name"))
    problem = F.when(F.col("x.value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "unquoted date").when(F.col("x.value").rlike("^(?i)(yes|no|on|off)$"), "yes or no")
    return rows.where(problem.isNotNull()).select("o_orderkey", F.concat(pointer, F.lit(": "), problem).alias("problem"))


@query("""SELECT o_orderkey, '{"lines":[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || '],"status":"' || o_orderstatus || '"}' AS doc FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def canonical_bundles(spark: SparkSession, d: str) -> DataFrame:
    """SNK04, SNK03, NST10: documents as JSON with their keys in order, written to a store and read back as they were."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))).alias("lines"))  # one order's lines
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    path = new_folder(spark, "bundles")
    o.select("o_orderkey", F.to_json(F.struct(*(F.col(c) for c in sorted(("status", "lines"))))).alias("doc")).write.parquet(path)
    return spark.read.schema("o_orderkey long, doc string").parquet(path)


@query("""SELECT p_partkey, 'new ' || p_brand || chr(10) || 'last' AS changed FROM part""")
def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    """SET11: lines that a new version puts in or replaces."""
    change = F.udf(lambda old, new: "\n".join(x for tag, _, _, a, b in difflib.SequenceMatcher(None, old.split("\n"), new.split("\n"), False).get_opcodes() if tag in ("insert", "replace") for x in new.split("\n")[a:b]), "string", useArrow=True)
    p = table(spark, d, "part")
    old = F.concat(F.lit("first\nold "), F.col("p_brand"), F.lit("\nsame "), F.col("p_name"), F.lit("\ngone"))
    new = F.concat(F.lit("first\nnew "), F.col("p_brand"), F.lit("\nsame "), F.col("p_name"), F.lit("\nlast"))
    return p.select("p_partkey", change(old, new).alias("changed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'text:q|cite:' || CAST(l_linenumber AS VARCHAR) || '億円:' || CAST(l_linenumber AS VARCHAR) || ':。|text:end' AS pieces FROM lineitem""")
def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    """STR32: a paragraph as text, numbers with units, and citations that keep the number before them."""
    n = F.col("l_linenumber").cast("string")
    form = F.udf(lambda t: "|".join(f"{k}:{x}" + (f":{','.join(map(str, c))}:{after}" if k == "cite" else "") for k, x, c, after in M.pieces(t)), "string", useArrow=True)
    text = F.concat(F.lit("q"), n, F.lit("億円 [S"), n, F.lit("]。end"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", form(text).alias("pieces"))


@query("""SELECT p_partkey, length(p_name) * 0.5 + 3 AS width FROM part""")
def display_widths(spark: SparkSession, d: str) -> DataFrame:
    """ADD70, STR44: the width of names on a display: half for ASCII letters, one for others."""
    shown = F.concat("p_name", F.lit("テスト"))
    wide = F.length(F.regexp_replace(shown, r"[\x00-\x7f]", ""))
    return table(spark, d, "part").select("p_partkey", ((F.length(shown) - wide) * 0.5 + wide).alias("width"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'end before start' WHEN o_orderkey % 4 = 1 THEN 'not a date' WHEN CAST(o_orderdate AS DATE) > DATE '1998-01-01' THEN 'future' ELSE '' END AS problem, CASE WHEN o_orderkey % 4 > 1 AND CAST(o_orderdate AS DATE) <= DATE '1998-01-01' THEN 3 ELSE 0 END AS days FROM orders""")
def date_parameters(spark: SparkSession, d: str) -> DataFrame:
    """DAT14, DAT12, DQ19: ranges of dates given as texts: both must be dates in order and not after the build date, which is a parameter."""
    today = S.build_day("1998-01-01")
    day = F.col("o_orderdate").cast("date")
    start = F.when(F.col("o_orderkey") % 4 == 1, "1995-13-01").otherwise(F.date_format(F.date_sub(day, 2), "yyyy-MM-dd"))
    end = F.date_format(F.when(F.col("o_orderkey") % 4 == 0, F.date_sub(day, 9)).otherwise(day), "yyyy-MM-dd")
    a, b = start.try_cast("date"), end.try_cast("date")
    problem = F.when(a.isNull() | b.isNull(), "not a date").when(b < a, "end before start").when(b > today, "future").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", problem.alias("problem"), F.when(problem == "", F.datediff(b, a) + 1).otherwise(0).alias("days"))


@query("""WITH a AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) FILTER (o_orderdate <= DATE '1998-06-01') AS day FROM orders GROUP BY 1), c AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_custkey, c.day IS NOT NULL AS covered, c.day IS NULL AND a.day IS NOT NULL AND DATE '1998-06-01' > (a.day - greatest(isodow(a.day) - 5, 0)::INTEGER) + CAST(5 + 2 * ((least(isodow(a.day), 5) - 1 + 5) // 5) AS INTEGER) AS stale FROM a LEFT JOIN c ON c.o_custkey = a.o_custkey AND c.day = a.day""")
def note_states(spark: SparkSession, d: str) -> DataFrame:
    """DAT07: the latest past announcement of a company, whether a note covers it, and whether its deadline of five weekdays is over."""
    today = S.build_day("1998-06-01")
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    latest = o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderdate") <= today.cast("timestamp_ntz"), F.col("day"))).alias("day"))
    notes = o.where("o_orderstatus = 'F'").select("o_custkey", "day", F.lit(True).alias("there")).distinct()
    rows = latest.join(notes, ["o_custkey", "day"], "left")
    covered = F.col("there").isNotNull()
    return rows.select("o_custkey", covered.alias("covered"), (~covered & F.col("day").isNotNull() & (today > S.add_business_days(F.col("day"), 5))).alias("stale"))


@query("""SELECT o_orderkey, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS number, CAST(CAST(v AS DOUBLE) AS DECIMAL(18,2)) = v AS exact, format('{:,}', CAST(floor(v) AS BIGINT)) || ' M' AS label FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)""")
def json_numbers(spark: SparkSession, d: str) -> DataFrame:
    """MTH02, MTH06, MTH07: whole amounts as integers, others with their decimals, whether a double holds them exactly, a grouped label with its unit."""
    v = money("o_totalprice")
    number = F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", number.alias("number"), (v.cast("double").cast("decimal(18,2)") == v).alias("exact"), F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" M")).alias("label"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '/a~1b/' || CAST(event_id AS VARCHAR) || '/m~0n' AS pointer FROM events""")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """NST05, NST02, NST03: JSON out of a fenced answer with words around it; pointers with their marks escaped."""
    answer = F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    inner = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    parts = F.array(F.lit("a/b"), F.col("event_id").cast("string"), F.lit("m~n"))
    pointer = F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "/"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(inner), "$.k", "bigint").alias("k"), pointer.alias("pointer"))


@query("""WITH u AS (SELECT event_type, sum(CAST(value AS DECIMAL(18,2))) AS own FROM events GROUP BY 1), t AS (SELECT sum(own) AS spent FROM u) SELECT event_type, CASE WHEN event_type = 'error' THEN 'paused' WHEN own + 50 > 20000 THEN 'own cap' WHEN spent + 50 > 90000 THEN 'total cap' ELSE 'go' END AS gate FROM u, t""")
def budget_gates(spark: SparkSession, d: str) -> DataFrame:
    """INC24: may an agent spend 50 more (calls one after another are `admitted_calls`): not while paused, not over its own cap or that of all; one row an agent."""
    own = table(spark, d, "events").groupBy("event_type").agg(F.sum(money("value")).alias("own"))
    spent = F.sum("own").over(Window.partitionBy(F.lit(1)))  # a row an agent
    rows = own.withColumn("spent", spent)
    return rows.select("event_type", F.when(F.col("event_type") == "error", "paused").when(F.col("own") + 50 > 20000, "own cap").when(F.col("spent") + 50 > 90000, "total cap").otherwise("go").alias("gate"))


@query("""WITH r AS (SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS used, length(text) AS n FROM conversations)
SELECT conv_id, CAST(count(*) FILTER (used <= 600) AS BIGINT) AS kept, CAST(count(DISTINCT role) FILTER (used <= 600) AS BIGINT) AS pages, bool_or(used > 600) AS truncated FROM r GROUP BY 1""")
def kept_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """ADD47: a document's first paragraphs up to a budget of characters, how many pages they come from, whether any are left out."""
    used = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = table(spark, d, "conversations").withColumn("used", used)
    within = F.col("used") <= 600
    return rows.groupBy("conv_id").agg(F.count_if(within).alias("kept"), F.countDistinct(F.when(within, F.col("role"))).alias("pages"), F.bool_or(~within).alias("truncated"))


@query("""SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY best DESC NULLS LAST, l_suppkey) AS companies FROM (SELECT l_orderkey, l_suppkey, max(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS best FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def process_companies(spark: SparkSession, d: str) -> DataFrame:
    """ADD14, SRT09, SRT03: a process's companies by falling sales, those without any last in either direction."""
    best = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))).alias("best"))
    lists = best.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("best").isNull().alias("none"), (-F.col("best")).alias("v"), "l_suppkey"))).alias("c"))  # one order's suppliers
    return lists.select("l_orderkey", F.array_join(F.transform("c", lambda x: x["l_suppkey"].cast("string")), ",").alias("companies"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS p, o_orderstatus = 'P' AS failed, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT k AS o_orderkey, 'first' AS commit, 'added' AS change, CAST(NULL AS DOUBLE) AS old, p AS new FROM o WHERE day < DATE '1996-01-01'
UNION ALL SELECT k, 'second', 'removed', p, NULL FROM o WHERE failed AND day < DATE '1996-01-01'
UNION ALL SELECT k, 'second', CASE WHEN day < DATE '1996-01-01' THEN 'replaced' ELSE 'added' END, CASE WHEN day < DATE '1996-01-01' THEN p END, p + 1 FROM o WHERE NOT failed AND day >= DATE '1995-01-01'""")
def audited_upserts(spark: SparkSession, d: str) -> DataFrame:
    """SET04, SET10: a table of orders until 1996, then those from 1995 on put in their place, failed ones deleted before; the log that the writes have kept, with old and new values."""
    from sorrel.sources import versions

    path = new_folder(spark, "audited")
    day, failed = F.col("o_orderdate").cast("date"), F.col("o_orderstatus") == "P"
    o = table(spark, d, "orders").select("o_orderkey", money("o_totalprice").cast("double").alias("price"), day.alias("day"), failed.alias("failed"))
    cut = lambda t: F.lit(t).cast("date")
    versions.upsert(spark, path, "orders", o.where(F.col("day") < cut("1996-01-01")).select("o_orderkey", "price"), ["o_orderkey"], "first", parts=8)
    new = o.where((F.col("day") >= cut("1995-01-01")) & ~F.col("failed")).select("o_orderkey", (F.col("price") + 1).alias("price"))
    for _ in range(2):  # the second time is a repeat
        versions.upsert(spark, path, "orders", new, ["o_orderkey"], "second", o.where("failed").select("o_orderkey"), parts=8)
    return versions.read(spark, path, "orders_log").select("o_orderkey", "commit", "change", F.col("old.price").alias("old"), F.col("new.price").alias("new"))


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds, CAST(min(o_orderkey) AS VARCHAR) || ' ' || arg_min(o_orderstatus, o_orderkey) AS first_row FROM orders GROUP BY 1""")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """AGG07: a summary by kind with its number, its states and its first row's detail."""
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("kinds"), F.concat(F.min("o_orderkey").cast("string"), F.lit(" "), F.min_by("o_orderstatus", "o_orderkey")).alias("first_row"))
