"""Texts: pages, similarity, claims, posts, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.functions.unicode import plain_form, search_key
from sorrel.operators import setjoin
from sorrel.operators.claims import check_numbers, extract_claims
from sorrel.operators.overlap import longest_runs
from sorrel.plans.metrics import money
from sorrel.plans.registry import query
from sorrel.sources.tables import table


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_sha FROM pages""")
def visible_texts(spark: SparkSession, d: str) -> DataFrame:
    """STR22, SRC24: a page's title and visible text."""
    return table(spark, d, "pages").select("page_id", S.html_title(F.col("html")).alias("title"), F.sha2(S.html_text(F.col("html")), 256).alias("text_sha"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href="[^"]*"')) AS BIGINT) AS links, CAST(len(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))) AS BIGINT) AS targets, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """SRC16: links, their distinct targets and paragraphs of each page."""
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("bigint").alias("links"), F.size(F.array_distinct(links)).cast("bigint").alias("targets"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"))


@query(r"""WITH m AS (SELECT doc_id, text, regexp_replace(text, 'https?://[A-Za-z0-9./?=&_%:~-]+', chr(1), 'g') AS a FROM documents), n AS (SELECT *, regexp_replace(a, '[0-9]{4}-[0-9]{2}-[0-9]{2}', chr(1), 'g') AS b FROM m)
SELECT doc_id, kind, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, unnest(['url', 'date', 'number']) AS kind, unnest([len(regexp_extract_all(text, 'https?://[A-Za-z0-9./?=&_%:~-]+')), len(regexp_extract_all(a, '[0-9]{4}-[0-9]{2}-[0-9]{2}')), len(regexp_extract_all(b, '[0-9][0-9,]*(?:[.][0-9]+)?'))]) AS n FROM n) WHERE n > 0""")
def claim_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what STR13 finds: urls, dates and numbers that texts claim; what is part of one kind isn't counted in the next."""
    return extract_claims(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS source, o_orderpriority AS label, round(CAST(o_totalprice AS DECIMAL(18,2)) / 1000, 0) * 1000 AS value FROM orders WHERE o_orderstatus <> 'F'), f AS (SELECT DISTINCT o_custkey AS source, o_orderpriority AS label, CAST(o_totalprice AS DECIMAL(18,2)) AS fact FROM orders WHERE o_orderstatus <> 'O')
SELECT claim_id, CASE WHEN coalesce(bool_or(abs(fact - value) <= 500), false) THEN 'grounded' WHEN count(fact) > 0 THEN 'contradiction' ELSE 'unsupported' END AS verdict FROM c LEFT JOIN f USING (source, label) GROUP BY 1""")
def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """MTH11: rounded amounts against the amounts of their source and label."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("label"), money("o_totalprice").alias("value"), "o_orderstatus")
    claims = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("claim_id"), "source", "label", (F.round(F.col("value") / 1000, 0) * 1000).alias("value"), F.lit(500).alias("tolerance"))
    return check_numbers(claims, o.where("o_orderstatus <> 'O'"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, list_distinct(list_transform(generate_series(1, greatest(length(p) - 1, 1)), lambda i: p[i:i+1])) AS g FROM (SELECT name, replace(name, ' ', '') AS p FROM n)),
s AS (SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(a.g || b.g)) AS DOUBLE), 6) AS similarity FROM g a JOIN g b ON a.name < b.name) SELECT * FROM s WHERE similarity >= 0.4""")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """STR16: names of which two share 0.4 of their pairs of characters or more."""
    n = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct().withColumn("g", S.bigrams(F.col("a")))
    return setjoin.pairs_within(n, "a", "g", 0.4).select("a", "b", F.round("similarity", 6).alias("similarity")).where("similarity >= 0.4")


#: Distinct pairs of characters of a text, as `letter_pairs` gives them.
PAIRS = "list_distinct(list_transform(range(1, greatest(length(p) - 1, 1) + 1), lambda i: p[i:i + 1]))"
PLAIN = "regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x{0B}\\x{A0}\\x{3000}、。，．,.「」『』（）()・:：;；]', '', 'g')"


@query(f"""WITH t AS (SELECT DISTINCT conv_id, turn, role, {PLAIN} AS p FROM conversations), g AS (SELECT DISTINCT md5(p) AS id, {PAIRS} AS g FROM t WHERE p <> '')
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(a.g || b.g)) AS DOUBLE), 6) AS similarity FROM g AS a JOIN g AS b ON a.id < b.id AND len(list_intersect(a.g, b.g)) >= 0.8 * len(list_distinct(a.g || b.g))""")
def similar_turns(spark: SparkSession, d: str) -> DataFrame:
    """STR16: distinct texts of conversations, whole, of which two share at least four fifths of their pairs of characters."""
    t = table(spark, d, "conversations").select(S.plain_letters(F.col("text")).alias("p")).where("p <> ''").distinct()
    t = t.select(F.md5("p").alias("a"), S.letter_pairs(F.col("p")).alias("g"))
    return setjoin.pairs_within(t, "a", "g", 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(r"""SELECT conv_id, turn, CAST(length(regexp_replace(text, 'https?://[^\s]+', repeat('x', 23), 'g')) AS BIGINT) AS post, CAST(len(regexp_extract_all(regexp_replace(text, 'https?://[^\s]+', '', 'g'), '#[A-Za-z0-9_]+')) AS BIGINT) AS tags, sha1_prefix AS print FROM (SELECT *, substr(sha1(role || ':' || text), 1, 10) AS sha1_prefix FROM conversations)""")
def post_rules(spark: SparkSession, d: str) -> DataFrame:
    """STR38, STR39, STR42: a post's length with short links, its tags outside links, a short fingerprint."""
    bare = F.regexp_replace("text", r"https?://[^\s]+", "")
    return table(spark, d, "conversations").select("conv_id", "turn", S.post_length(F.col("text")).cast("bigint").alias("post"), F.regexp_count(bare, F.lit("#[A-Za-z0-9_]+")).cast("bigint").alias("tags"), S.fingerprint(F.col("role"), F.col("text")).alias("print"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+', '[mail]', 'g'), '[0-9]{4,}', '[number]', 'g'), '[ \t\n]+', ' ', 'g')) AS masked_sha FROM documents""")
def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    """STR41, STR45: addresses and long numbers masked, white space collapsed."""
    masked = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "[mail]"), "[0-9]{4,}", "[number]")
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace(masked, "[ \t\n]+", " "), 256).alias("masked_sha"))


@query(r"""SELECT p_partkey, regexp_replace(p_name, '( (widget|ring))+$', '') AS head, CASE WHEN regexp_matches(p_name, '^[a-m]') THEN 'A-M' WHEN regexp_matches(p_name, '^[n-z]') THEN 'N-Z' ELSE 'other' END AS heading, format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) AS price FROM part""")
def labelled_names(spark: SparkSession, d: str) -> DataFrame:
    """STR27, STR28, STR33, MTH06, MTH07: names without their tail words, headings by first letter, grouped numbers."""
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", "( (widget|ring))+$", "").alias("head"), F.when(F.col("p_name").rlike("^[a-m]"), "A-M").when(F.col("p_name").rlike("^[n-z]"), "N-Z").otherwise("other").alias("heading"), F.format_number(F.floor("p_retailprice"), 0).alias("price"))


_KEYWORDS = ("the", "und", "que")


@query("SELECT doc_id, words FROM (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN '{w}' END" for w in _KEYWORDS) + ") AS words FROM documents) WHERE words <> ''")
def keyword_texts(spark: SparkSession, d: str) -> DataFrame:
    """STR25: texts that hold any of the words on their boundaries, with the words that they hold."""
    low = F.lower("text")
    words = F.concat_ws(",", *(F.when(low.rlike(f"(^|[^a-z0-9]){w}($|[^a-z0-9])"), w) for w in _KEYWORDS))
    return table(spark, d, "documents").select("doc_id", words.alias("words")).where("words <> ''")


@query(None)
def compatible_texts(spark: SparkSession, d: str) -> DataFrame:
    """STR02, STR03, STR04: lengths of two normal forms after compatibility normalisation, which neither engine has built in."""
    return table(spark, d, "documents").select("doc_id", F.length(plain_form(F.col("text"))).cast("bigint").alias("n"), F.length(search_key(F.col("text"))).cast("bigint").alias("n_search"))


#: Windows of 30 letters of both sides in their plain form, and where the items' stand in documents.
WINDOWS = r"""x AS (SELECT item_id, regexp_replace(regexp_replace(coalesce(text, ''), '\[S[0-9]+\]', '', 'g'), '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]', '', 'g') AS p FROM benchmark), y AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\[S[0-9]+\]', '', 'g'), '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]', '', 'g') AS p FROM documents),
xw AS (SELECT item_id, i, p[i + 1:i + 30] AS w FROM (SELECT item_id, p, unnest(range(length(p) - 29)) AS i FROM x)), yw AS (SELECT doc_id, j, p[j + 1:j + 30] AS w FROM (SELECT doc_id, p, unnest(range(length(p) - 29)) AS j FROM y))"""


@query(f"""WITH {WINDOWS}, met AS (SELECT item_id, doc_id, i, i - j AS d FROM xw JOIN yw USING (w)), runs AS (SELECT item_id, doc_id, d, i - row_number() OVER (PARTITION BY item_id, doc_id, d ORDER BY i) AS run FROM met),
best AS (SELECT item_id, max(n) AS longest FROM (SELECT item_id, count(*) + 29 AS n FROM runs GROUP BY item_id, doc_id, d, run) GROUP BY 1)
SELECT item_id, CAST(coalesce(longest, 0) AS INTEGER) AS longest, longest IS NOT NULL AS failed FROM benchmark LEFT JOIN best USING (item_id)""")
def reprinted_items(spark: SparkSession, d: str) -> DataFrame:
    """STR06, STR09, STR10, AGG13: the longest run of 30 or more characters that each benchmark text shares with any document."""
    return longest_runs(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")
