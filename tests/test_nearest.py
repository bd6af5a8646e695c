"""One-to-one pairs by the distance of a number, against all pairs in order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sorrel.operators import nearest


def taken(left, right, least):
    pairs = sorted((-1 / (1 + abs(x - y)), a, b, g) for g, a, x in left for h, b, y in right if g == h and 1 / (1 + abs(x - y)) >= least)
    used, out = set(), set()
    for s, a, b, g in pairs:
        if not {(g, 0, a), (g, 1, b)} & used:
            used |= {(g, 0, a), (g, 1, b)}
            out.add((g, a, b, -s))
    return out


@pytest.mark.parametrize(("cell", "step"), [(1, 0.01), (1, 1), (8, 0.5)])
def test_pairs_equal_a_loop(spark, monkeypatch, cell, step):
    """Edges of cells among the rows, equal values and equal distances on both sides."""
    monkeypatch.setattr(nearest, "CELL", cell)
    rng = random.Random(5)
    side = lambda n: [(rng.randrange(3), k, float(round(rng.randint(-200, 200) / step) * step) if rng.random() < 0.9 else 7.0) for k in rng.sample(range(10_000), n)]
    left, right = side(150), side(400)
    a = spark.createDataFrame([*left, left[0], (None, 1, 1.0), (1, 20_001, None), (1, 20_002, float("nan"))], "g int, l long, x double").repartition(3)
    b = spark.createDataFrame([*right, (None, 1, 1.0), (1, 20_003, float("inf"))], "g int, r long, y double")
    got = nearest.nearest_pairs(a, b, "g", "l", "r", ("x", "y"), 0.05).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == taken(left, right, 0.05)


def test_equal_values_are_no_rounds_of_their_own(spark):
    """As many rows of one value as there are: they are used up in order at once, not a pair a round, and without their pairs."""
    a = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("l"), F.lit(10.0).alias("x"))
    got = nearest.nearest_pairs(a, a.select("g", F.col("l").alias("r"), (F.col("x") + 1).alias("y")), "g", "l", "r", ("x", "y"), 0.015)
    assert got.where("l = r AND score = 0.5").count() == got.count() == 3000
