"""Stateful merges, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.operators.merge import folded_cells, ingest
from sorrel.plans.metrics import money
from sorrel.plans.registry import query
from sorrel.sources.tables import table
from sorrel.streaming import merges, windows


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, list(struct_pack(d := o_orderdate, k := o_orderkey, v := CAST(o_totalprice AS DECIMAL(18,2)), c := o_orderstatus = 'F', s := o_orderkey, r := 0) ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY 1, 2),
f AS (SELECT o_custkey, o_orderpriority, list_reduce(l, lambda a, x: CASE WHEN a.v = x.v OR (x.c AND abs(a.v - x.v) < 20000) THEN a ELSE struct_pack(d := x.d, k := x.k, v := x.v, c := x.c, s := x.s, r := a.r + 1) END) AS x FROM v)
SELECT o_custkey, o_orderpriority, CAST(x.v AS DOUBLE) AS value, x.s AS source, CAST(x.r AS BIGINT) AS n_revisions FROM f""")
def merged_state(spark: SparkSession, d: str) -> DataFrame:
    """INC05, INC06: cells folded in the order of their sources; coarse versions that hardly differ keep the older value."""
    o = table(spark, d, "orders").withColumn("amount", money("o_totalprice"))
    cells = folded_cells(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "amount", "o_orderkey", F.col("o_orderstatus") == "F", F.lit(20000))
    return cells.select("o_custkey", "o_orderpriority", F.col("value").cast("double").alias("value"), "source", F.col("n_revisions").cast("bigint").alias("n_revisions"))


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS fy, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'transient' END AS error FROM orders), w AS (SELECT *, max(CASE WHEN error IS NULL THEN o_orderkey END) OVER (PARTITION BY o_custkey, fy ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM o)
SELECT o_custkey, CAST(fy AS BIGINT) AS fy, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL AND later IS NOT NULL) AS superseded, max(CASE WHEN error IS NULL AND later IS NULL THEN o_orderkey END) AS current FROM w GROUP BY 1, 2""")
def ingested_periods(spark: SparkSession, d: str) -> DataFrame:
    """INC01, INC02, INC14: documents, some of which come twice, with their states counted for each period."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("fy"), "o_orderdate", "o_orderkey", "o_orderstatus")
    docs = o.unionByName(o.where("o_orderkey % 4 = 0"))
    rows = ingest(docs, ["o_custkey", "fy"], ["o_orderdate", "o_orderkey"], "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("transient")))
    is_ = lambda s: F.col("status") == s
    return rows.groupBy("o_custkey", F.col("fy").cast("bigint").alias("fy")).agg(F.count_if(is_("failed")).alias("failed"), F.count_if(is_("superseded")).alias("superseded"), F.max(F.when(is_("ingested"), F.col("o_orderkey"))).alias("current"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts as a stream: counts and sums by day and kind, with a watermark for late rows."""
    e = windows.read(spark, f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    counted = windows.by_window(e, "at", "1 day", "40 days", ["event_type"], {"n": F.count("*"), "total": F.sum(money("value"))})
    rows = windows.settled(counted, ["start", "event_type"])
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("""SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1""")
def streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """INC01, INC06 as a stream: the latest row of each key by event time, whatever order rows come in, and how many came."""
    e = windows.read(spark, f"{d}/events.parquet").select("user_id", "ts", "event_id")
    return merges.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "n")


#: Events by the week in which they come: their own, errors one week later.
_WEEKS = "w AS (SELECT *, CAST((day(ts) - 1) // 7 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS week FROM events)"


@query(f"""WITH {_WEEKS}, m AS (SELECT week, max(ts) AS latest FROM w GROUP BY 1), k AS (SELECT w.*, (SELECT max(latest) FROM m WHERE m.week <= w.week - 2) - INTERVAL 2 DAY AS mark FROM w)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM k WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1, 2""")
def late_windows(spark: SparkSession, d: str) -> DataFrame:
    """SET01 as a stream: counts and sums by day and kind over weekly micro-batches; what comes after its day has closed is dropped.

    A window closes when the watermark that the batch before last has left is past its end.
    """
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type", money("value").alias("value"))
    week = F.expr("(day(at) - 1) div 7").cast("int") + F.when(F.col("event_type") == "error", 1).otherwise(0)
    stream = windows.staged(e.withColumn("week", week), "week", range(6))
    counted = windows.by_window(stream, "at", "1 day", "2 days", ["event_type"], {"n": F.count("*"), "total": F.sum("value")})
    rows = windows.settled(counted, ["start", "event_type"])
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query(f"""WITH {_WEEKS}, f AS (SELECT user_id, min(week) AS week FROM w GROUP BY 1) SELECT user_id, CAST(f.week AS INTEGER) AS week, count(*) AS n FROM f JOIN w USING (user_id, week) GROUP BY 1, 2""")
def first_weeks(spark: SparkSession, d: str) -> DataFrame:
    """SET01, SRC18 as a stream: keys seen before are left out over weekly micro-batches; each key with the week in which it came first."""
    from sorrel.session import new_folder
    from sorrel.streaming import attempts

    week = F.expr("(day(ts) - 1) div 7").cast("int") + F.when(F.col("event_type") == "error", 1).otherwise(0)
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").withColumn("week", week)
    weeks = e.groupBy("user_id", "week").agg(F.count("*").alias("n"), F.max("ts").alias("at"))
    stream = windows.staged(weeks.withColumn("batch", F.col("week")), "batch", range(6))
    path = new_folder(spark, "first")
    seen = attempts.first_seen(stream, "user_id", "at", "60 days")
    seen.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, week int, n bigint, at timestamp").parquet(windows.folder_of(spark, f"{path}/out")).select("user_id", "week", "n")
