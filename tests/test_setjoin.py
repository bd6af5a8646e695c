"""Similarity joins against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sorrel.functions import scalars as S
from sorrel.operators import setjoin


def jaccard(x, y):
    x, y = set(x), set(y)
    return len(x & y) / len(x | y)


def rows(seed, n, words, most, groups):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice([0, 1, 2, 3, rng.randint(1, most)])
        tokens = [f"t{min(int(rng.paretovariate(0.7)), words)}" for _ in range(size)]
        out.append((rng.randrange(groups), k, tokens))
        if rng.random() < 0.2:
            out[-1] = (out[-1][0], k, rng.choice(out)[2][: rng.randint(0, most)])
    return out


@pytest.fixture(scope="module", params=[(1, 260, 40, 12, 1), (2, 260, 500, 30, 4), (3, 200, 6, 8, 2)])
def sides(request, spark):
    seed, n, words, most, groups = request.param
    left, right = rows(seed, n, words, most, groups), [(g, k + 5000, t) for g, k, t in rows(seed + 50, n, words, most, groups)]
    right += [(g, k + 9000, t) for g, k, t in left[:40]]
    frame = lambda x, key: spark.createDataFrame(x, f"g int, {key} long, tokens array<string>").repartition(3)
    return left, right, frame(left, "l"), frame(right, "r")


@pytest.mark.parametrize("bound", [0.15, 0.4, 0.8, 1.0])
@pytest.mark.parametrize("frequent", [0, 5, 10**6])
def test_pairs_equal_all_pairs(sides, bound, frequent):
    left, right, a, b = sides
    want = {(g, k, m): jaccard(x, y) for g, k, x in left for h, m, y in right if g == h and x and y and jaccard(x, y) >= bound}
    got = [tuple(r) for r in setjoin.similar_pairs(a, b, "l", "r", "tokens", bound, ["g"], frequent).collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == pytest.approx(want)


@pytest.mark.parametrize("bound", [0.15, 0.8])
def test_frequent_tokens_meet_in_tiles(sides, monkeypatch, bound):
    """Sets of frequent tokens alone are dealt into blocks and counted by matrices, in parts of the tokens."""
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    monkeypatch.setattr(setjoin, "TOKENS", 7)
    left, right, a, b = sides
    want = {(g, k, m): jaccard(x, y) for g, k, x in left for h, m, y in right if g == h and x and y and jaccard(x, y) >= bound}
    got = [tuple(r) for r in setjoin.similar_pairs(a, b, "l", "r", "tokens", bound, ["g"], 0).collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == pytest.approx(want)


def test_best_matches_equal_all_pairs(sides):
    left, right, a, b = sides
    want = {}
    for g, k, x in left:
        met = [(-jaccard(x, y), m) for h, m, y in right if g == h and x and y and jaccard(x, y) >= 0.15]
        if met:
            want[g, k] = min(met)[1]
    got = setjoin.best_matches(a, b, "l", "r", "tokens", 0.15, ["g"], 5).collect()
    assert len(got) == len(want) and {(r["g"], r["l"]): r["r"] for r in got} == want


@pytest.mark.parametrize("few", [0, 170, 10**6])
def test_small_groups_are_compared_pair_by_pair(sides, monkeypatch, few):
    """Groups of few rows make no row a token; those above the number do, with the same best matches."""
    left, right, a, b = sides
    monkeypatch.setattr(setjoin, "FEW", few)
    if few == 10**6:
        monkeypatch.setattr(setjoin, "_ordered", lambda *_: pytest.fail("tokens were exploded"))
    want = {}
    for g, k, x in left:
        met = [(-jaccard(x, y), m) for h, m, y in right if g == h and x and y and jaccard(x, y) >= 0.15]
        if met:
            want[g, k] = min(met)[1]
    again = a.unionByName(a.where("l % 7 = 0")).unionByName(spark_row(a))
    got = [(r["g"], r["l"], r["r"]) for r in setjoin.best_matches(again, b, "l", "r", "tokens", 0.15, ["g"], 5).collect()]
    assert sorted(got) == sorted((g, k, m) for (g, k), m in want.items() for _ in range(1 + (k % 7 == 0)))


def spark_row(a):
    """A row of a null group."""
    return a.limit(1).withColumn("g", F.lit(None).cast("int")).withColumn("tokens", F.array(F.lit("t1")))


@pytest.mark.parametrize("few", [0, 40])
def test_assignment_of_groups_of_any_size(spark, monkeypatch, few):
    monkeypatch.setattr(setjoin, "FEW", few)
    test_assignment_equals_a_loop(spark)


def test_assignment_equals_a_loop(spark):
    left, right = rows(7, 60, 30, 10, 3), [(g, k + 500, t) for g, k, t in rows(8, 60, 30, 10, 3)]
    pairs = sorted((-jaccard(x, y), k, m, g) for g, k, x in left for h, m, y in right if g == h and x and y and jaccard(x, y) >= 0.15)
    used, want = set(), {}
    for _, k, m, _ in pairs:
        if not {k, m} & used:
            used |= {k, m}
            want[k] = m
    a, b = spark.createDataFrame(left, "g int, l long, tokens array<string>"), spark.createDataFrame(right, "g int, r long, tokens array<string>")
    got = setjoin.assigned(a, b, "l", "r", "tokens", 0.15, "g").collect()
    assert len(got) == len(want) and {r["l"]: r["r"] for r in got} == want


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (None, 2, ["a"]), (1, 3, [])], "g int, l long, tokens array<string>")
    assert setjoin.similar_pairs(df, df.withColumnRenamed("l", "r"), "l", "r", "tokens", 0.5, ["g"]).count() == 0
    assert setjoin.best_matches(df.where("false"), df.withColumnRenamed("l", "r"), "l", "r", "tokens", 0.5).count() == 0


def test_a_frequent_token_is_no_key(spark):
    """A token that all sets hold makes no candidates: the join's rows stay in proportion to the sets."""
    df = spark.range(3000).select(F.col("id").alias("l"), F.array(F.lit("all"), *(F.concat(F.lit(f"{k}-"), F.col("id")) for k in range(5))).alias("tokens"))
    ordered = setjoin._ordered(df, [])
    keys = setjoin._keys(ordered, [], 0.4, 128)
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] == 1
    assert setjoin.similar_pairs(df, df.withColumnRenamed("l", "r"), "l", "r", "tokens", 0.4).count() == 3000


def test_pairs_of_letters(spark):
    df = spark.createDataFrame([("A, b（C)",), ("x",), ("",), (None,), ("aaa",)], "t string").select(S.letter_pairs(F.col("t")).alias("g"))
    assert [r["g"] for r in df.collect()] == [["ab", "bc"], ["x"], [""], None, ["aa"]]


@pytest.mark.parametrize("vocabulary", [0, 32767])
@pytest.mark.parametrize("frequent", [0, 5, 10**6])
def test_pairs_within(sides, monkeypatch, frequent, vocabulary):
    """Each pair of rows once, the smaller key first, also of rows with equal sets; tiles of few sets and bits of any number of tokens."""
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    monkeypatch.setattr(setjoin, "TOKENS", 7 if vocabulary else 10**6)
    monkeypatch.setattr(setjoin, "PARTS", 3)
    monkeypatch.setattr(setjoin, "VOCABULARY", vocabulary)
    left, _, a, _ = sides
    want = {(k, m): jaccard(x, y) for _, k, x in left for _, m, y in left if k < m and x and y and jaccard(x, y) >= 0.4}
    got = [tuple(r) for r in setjoin.pairs_within(a, "l", "tokens", 0.4, (), frequent).collect()]
    assert len(got) == len(want) and {r[:2]: r[2] for r in got} == pytest.approx(want)


def test_pairs_of_tiles_are_not_written(spark, tmp_path, monkeypatch):
    """Many similar pairs of sets of frequent tokens: what is written for them follows from the sets, not from the pairs."""

    def kept(df, name):
        path = str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    monkeypatch.setattr(setjoin, "kept", kept)
    df = spark.range(1500).select(F.col("id").alias("l"), F.expr("transform(sequence(1, 55), i -> concat('t', pmod(xxhash64(id, i), 60)))").alias("tokens"))
    pairs = setjoin.pairs_within(df, "l", "tokens", 0.5, (), 10).count()
    assert pairs > 150_000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file()) < 4 * pairs
