"""Operators that SQL can't express, and the properties of those that it can."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.functions.unicode import compatible, search_key
from sorrel.operators import claims, merge, overlap
from sorrel.operators import relational as R


def plain_longest(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


@pytest.mark.parametrize("most", [overlap.WINDOWS, 0])
def test_longest_runs_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(overlap, "WINDOWS", most)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij") for _ in range(3000))
    sources = [(k, "".join(rng.choice("klmnop") for _ in range(50)) + base[a : a + n] + " tail") for k, (a, n) in enumerate([(0, 29), (100, 30), (300, 31), (500, 200), (900, 64), (1200, 0)])]
    drafts = [(k, "x" + base[a : a + n] + "yz") for k, (a, n) in enumerate([(0, 60), (100, 60), (290, 60), (480, 300), (870, 100), (2000, 500)])] + [(9, ""), (10, None)]
    a, b = spark.createDataFrame(drafts, "draft int, text string"), spark.createDataFrame(sources, "source int, text string")
    got = {(r["draft"], r["source"]): r["longest"] for r in overlap.shared_runs(a, b, "draft", "source").collect()}
    want = {(d, s): n for d, t in drafts for s, u in sources if (n := plain_longest(overlap.plain(t or ""), overlap.plain(u))) >= 30}
    assert got == want and want
    best = {r["draft"]: (r["longest"], r["failed"]) for r in overlap.longest_runs(a, b, "draft", "source").collect()}
    assert best[0] == (0, False) and best[1] == (30, True) and best[9] == (0, False)


def test_a_line_that_all_texts_hold_is_one_fragment(spark):
    """Drafts and sources that share one line make no row for each pair of them."""
    line = "this line stands in each and every one of all these texts"
    a = spark.range(300).select(F.col("id").alias("draft"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(line), F.sha2((-F.col("id")).cast("string"), 256)).alias("text"))
    x, y = overlap.fragments(a, a.select((F.col("draft") + 1000).alias("source"), F.concat(F.upper(F.sha2("text", 256)), F.lit(f"-{line}-"), F.upper(F.sha2("text", 224))).alias("text")), "draft", "source", 30)
    assert x.select("text").distinct().count() < 10 and y.select("text").distinct().count() < 10 and x.select("draft").distinct().count() == 300


def test_a_mark_within_a_mark(spark):
    a = spark.createDataFrame([(1, "[S[S1]2]" + "abcdefghij" * 4)], "draft int, text string")
    got = overlap.longest_runs(a, a.withColumnRenamed("draft", "source"), "draft", "source").first()
    assert got["longest"] == 44


def test_width_and_space_are_ignored(spark):
    a = spark.createDataFrame([(1, "ＡＢＣ " + "d e f " * 10)], "draft int, text string")
    b = spark.createDataFrame([(1, "ABC" + "def" * 10)], "source int, text string")
    assert overlap.longest_runs(a, b, "draft", "source").first()["longest"] == 33


def test_merge_is_the_same_in_any_order(spark):
    rows = [("a", k, f"d{k}", v, c) for k, (v, c) in enumerate([(100.0, False), (100.4, True), (99.3, True), (98.0, True), (None, False), (98.9, True), (98.9, False)])]
    rows += [("b", 3, "d3", 5.0, False), ("b", 1, "d1", 7.0, False)]

    def run(order):
        df = spark.createDataFrame([rows[i] for i in order], "cell string, at int, doc string, v double, coarse boolean")
        got = merge.folded_cells(df, ["cell"], ["at", "doc"], "v", "doc", F.col("coarse"), F.lit(1.0)).collect()
        return {r["cell"]: (r["value"], r["source"], r["n_revisions"], [(x["source"], x["old"], x["new"]) for x in r["revisions"]]) for r in got}

    want = {"a": (98.9, "d6", 2, [("d3", 100.0, 98.0), ("d6", 98.0, 98.9)]), "b": (5.0, "d3", 1, [("d3", 7.0, 5.0)])}
    rng = random.Random(6)
    for _ in range(3):
        order = list(range(len(rows)))
        rng.shuffle(order)
        assert run(order) == want


def test_ingest_is_idempotent(spark):
    rows = [("c", 1, "d1", None), ("c", 2, "d2", "bad"), ("c", 3, "d3", None), ("c", 3, "d3", None), ("e", 1, "d4", None)]
    df = spark.createDataFrame(rows, "company string, at int, doc string, error string")
    for docs in (df, df.union(df)):
        got = {r["doc"]: (r["status"], r["supersedes"]) for r in merge.ingest(docs, ["company"], ["at", "doc"], "doc", F.col("error")).collect()}
        assert got == {"d1": ("superseded", None), "d2": ("failed", "d1"), "d3": ("ingested", "d1"), "d4": ("ingested", None)}


def test_claims_and_acknowledgements(spark):
    texts = spark.createDataFrame([(1, "On 2026-10-05 sales were 1,234.5; see https://a.example/x?y=2 or 12."), (2, None), (3, "none")], "doc int, text string")
    got = [(r["doc"], r["kind"], r["claim"]) for r in claims.extract_claims(texts, "doc", "text").collect()]
    assert sorted(got) == [(1, "date", "2026-10-05"), (1, "number", "1,234.5"), (1, "number", "12"), (1, "url", "https://a.example/x?y=2")]
    c = spark.createDataFrame([(1, "s", "sales", 10.0, 0.5), (2, "s", "sales", 20.0, 0.5), (3, "s", "staff", 10.0, 0.5)], "claim_id int, source string, label string, value double, tolerance double")
    f = spark.createDataFrame([("s", "sales", 10.4), ("s", "sales", 10.4), ("t", "staff", 10.0)], "source string, label string, value double")
    assert {r["claim_id"]: r["verdict"] for r in claims.check_numbers(c, f).collect()} == {1: "grounded", 2: "contradiction", 3: "unsupported"}
    results = spark.createDataFrame([("a", "p1", "unsupported"), ("a", "p2", "contradiction"), ("b", "p2", "contradiction"), ("b", "p3", "grounded")], "file string, print string, verdict string")
    acks = spark.createDataFrame([(None, "p1"), ("a", "p2")], "file string, print string")
    assert [(r["file"], r["print"]) for r in claims.unacknowledged(results, acks).collect()] == [("b", "p2")]


def test_greedy_pairs_use_each_side_once(spark):
    pairs = [("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.85), ("g", 2, 2, 0.2), ("g", 3, 2, 0.1), ("h", 1, 1, 0.5)]
    df = spark.createDataFrame(pairs, "unit string, a int, b int, score double")
    got = sorted((r["unit"], r["a"], r["b"]) for r in R.greedy_pairs(df, "unit", "a", "b", "score", 0.15).collect())
    assert got == [("g", 1, 1), ("g", 2, 2), ("h", 1, 1)]


@pytest.mark.parametrize("part, whole, want", [(12345, 100000, 12.3), (1, 2000, 0.1), (-1, 2000, -0.1), (1, 3000, 0.0), (-1900, 361700, -0.5), (-1, 1000000, 0.0), (5, 0, None), (None, 5, None)])
def test_percentages_round_half_away_from_zero(spark, part, whole, want):
    got = spark.createDataFrame([(part, whole)], "p int, w int").select(S.ratio_percent(F.col("p"), F.col("w")).alias("x")).first()["x"]
    assert got == want and str(got) != "-0.0"


def test_unicode_forms(spark):
    df = spark.createDataFrame([("Ａｂ カタカナ　ｶﾅ",), (None,)], "t string").select(compatible(F.col("t")).alias("n"), search_key(F.col("t")).alias("k"))
    assert [tuple(r) for r in df.collect()] == [("Ab カタカナ カナ", "abかたかなかな"), (None, None)]


@pytest.mark.parametrize("url, want", [("HTTP://A.Example/X?utm_source=f&b=2#top", "http://a.example/X?b=2"), ("https://a.example/?utm_medium=x", "https://a.example/"), ("https://a.example/y?a=1&utm_x=2&c=3", "https://a.example/y?a=1&c=3")])
def test_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(S.normalize_url(F.col("u")).alias("x")).first()["x"] == want


def test_stream_merges_late_rows(spark, tmp_path):
    from sorrel.streaming import merges, windows

    first = spark.createDataFrame([(1, "2026-01-02", "b"), (2, "2026-01-01", "x")], "k int, at string, v string")
    late = spark.createDataFrame([(1, "2026-01-01", "a"), (2, "2026-01-03", "y")], "k int, at string, v string")
    for df in (first, late):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.read(spark, str(tmp_path / "in"))
    got = {r["k"]: (r["v"], r["n"]) for r in merges.latest(stream, ["k"], ["at"]).collect()}
    assert got == {1: ("b", 2), 2: ("y", 2)}


def test_dated_lines_stay_in_their_partitions(spark, sf_dir):
    """A join's rows are dealt by their number; partitions put together by compressed bytes hold many times that in memory."""
    from sorrel.plans import catalog
    from sorrel.session import dealt

    assert dealt(spark.range(10), "id", 100, 2).rdd.getNumPartitions() == 50
    plan = catalog.QUERIES["event_problems"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
