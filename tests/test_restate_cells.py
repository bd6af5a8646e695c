"""Cells that later documents restate, and members that come and go, in any order of arrival."""

from __future__ import annotations

import random

from sorrel.operators import restate

EVENTS = [
    ("a", 1, 1, False, 7.0), ("a", 2, 2, True, 100.0), ("a", 3, 3, False, 100.4), ("a", 4, 4, False, 90.0), ("a", 5, 5, True, None), ("a", 6, 6, False, 80.0), ("a", 7, 7, True, 85.0), ("a", 8, 8, True, 85.0),
    ("b", 1, 9, False, 5.0), ("c", 1, 1, True, 10.0), ("c", 2, 2, True, 10.3),
]


def test_cells_are_the_same_in_any_order(spark):
    rows = list(EVENTS)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, at int, doc long, own boolean, value double").repartition(3)
        got = {r["k"]: (r["value"], r["source"], [tuple(x) for x in r["revisions"]]) for r in restate.restated_cells(df, ["k"], "at", 1.0).collect()}
        assert got == {"a": (85.0, 8, [(4, 4, 2, 100.0, 90.0), (5, 5, 4, 90.0, None), (7, 7, 5, None, 85.0)]), "c": (10.0, 1, [])}  # a prior column says nothing where there is no value; 100.4 and 10.3 hardly differ


def test_members_that_come_and_go(spark):
    rows = [("a", 1, 1, False, ["Z"]), ("a", 2, 2, True, ["X", "Y"]), ("a", 3, 3, False, ["Y", "X"]), ("a", 4, 4, False, ["Y", "W", "V"]), ("a", 5, 5, True, [])]
    df = spark.createDataFrame(rows, "k string, at int, doc long, own boolean, m array<string>")
    got = [tuple(r) for r in restate.member_changes(df, ["k"], "at", "m").orderBy("at").collect()]
    assert got == [("a", 4, 4, ["V", "W"], ["X"]), ("a", 5, 5, [], ["V", "W", "Y"])]
    assert restate.member_changes(df.where("false"), ["k"], "at", "m").count() == 0
