"""Sequential budgets and leaves of nested documents against plain loops."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sorrel.operators import gates, nested

CALLS = "k long, day string, agent string, estimate long, cost long, own string"


def plain_admission(calls, own_caps, caps):
    spent, out = {}, {}
    for k, day, agent, estimate, cost, _ in sorted(calls, key=lambda c: c[0]):
        own, total = spent.get((day, agent), 0), spent.get(day, 0)
        out[k] = estimate is not None and agent in own_caps and day in caps and estimate <= min(own_caps[agent] - own, caps[day] - total)
        if out[k]:
            spent[day, agent], spent[day] = own + (cost or 0), total + (cost or 0)
    return out


def many_calls():
    rng = random.Random(3)
    days, agents = ["a", "b", "c", "d", None], ["x", "y", "z", None]
    return [(k, rng.choice(days), rng.choice(agents), rng.choice([None, 0, *range(1, 60)]), rng.choice([None, 0, *range(1, 60)]), "kept") for k in range(3000)]


OWN, CAPS = {"x": 2000, "y": 40000, "z": 300}, {"a": 5000, "b": 50, "c": 10**7}


def caps(spark):
    return spark.createDataFrame(list(OWN.items()), "agent string, cap long"), spark.createDataFrame(list(CAPS.items()), "day string, cap long")


def test_a_refused_call_costs_nothing(spark):
    calls = spark.createDataFrame([(1, "a", "x", 5, 5, ""), (2, "a", "x", 100, 100, ""), (3, "a", "x", 2, 2, "")], CALLS)
    got = gates.admission(calls, spark.createDataFrame([("x", 10)], "agent string, cap long"), spark.createDataFrame([("a", 10)], "day string, cap long"), "day", "agent", ["k"], "estimate", "cost")
    assert {r["k"]: r["admitted"] for r in got.collect()} == {1: True, 2: False, 3: True}


def test_admission_equals_a_loop(spark):
    calls = many_calls()
    df = spark.createDataFrame(calls, CALLS).repartition(6)
    got = gates.admission(df, *caps(spark), "day", "agent", ["k"], "estimate", "cost")
    assert got.columns == [*df.columns, "admitted"]
    assert {r["k"]: r["admitted"] for r in got.collect()} == plain_admission(calls, OWN, CAPS)
    assert gates.admission(df.where("false"), *caps(spark), "day", "agent", ["k"], "estimate", "cost").count() == 0


def test_ample_periods_are_all_admitted(spark):
    calls = [(k, "c", "y", 5, 4, "") for k in range(100)]
    df = spark.createDataFrame(calls, CALLS)
    assert gates.admission(df, *caps(spark), "day", "agent", ["k"], "estimate", "cost").where("admitted").count() == 100


def test_a_stream_of_several_batches_gives_the_same_rows(spark, tmp_path):
    calls = [c for c in many_calls() if c[1] is not None]
    for i in range(4):
        spark.createDataFrame(calls[i * 700 : (i + 1) * 700], CALLS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gates.STATE_STORE)
    try:
        for run in range(2):  # the second finds nothing new: what the first has admitted stays
            stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            admitted = gates.admission_stream(stream, *caps(spark), "day", "agent", ["k"], "estimate", "cost")
            q = admitted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert run or len([p for p in q.recentProgress if p["numInputRows"]]) == 4
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r["k"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain_admission(calls[:2800], OWN, CAPS)


def plain_leaves(v, pointer="", under=None, members=()):
    members = dict(members)
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from plain_leaves(x, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", k, members)
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            name = x.get(members[under]) if under in members and isinstance(x, dict) else None
            name = str(i) if name is None else str(name).replace("~", "~0").replace("/", "~1")
            yield from plain_leaves(x, f"{pointer}/{name}", None, members)
    else:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
        yield pointer, kind, {"object": "{}", "array": "[]", "null": None, "boolean": str(v).lower()}.get(kind, str(v))


DOCUMENTS = [
    {"a": 1, "b": {"c/d": [1, [2, [3, {"e~": None}]]], "": "x"}, "f": [], "g": {}}, [], {}, 5, "text", None, True, [[[[[[]]]]]], [{"n": "p/q", "v": 1}, {"v": 2}],
    {"lines": [{"n": "b", "v": [1, 2]}, {"n": "a", "v": []}, 7, {"v": 3}], "other": {"lines": [[{"n": "deep"}]]}},
]


@pytest.mark.parametrize("members", [{}, {"lines": "n"}])
def test_leaves_of_any_shape(spark, members):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(DOCUMENTS)] + [(90, None), (91, "{broken")], "k long, doc string")
    got = {(r["k"], r["pointer"], r["kind"], r["value"]) for r in nested.leaves(df, ["k"], "doc", members).collect()}
    assert got == {(i, *leaf) for i, x in enumerate(DOCUMENTS) for leaf in plain_leaves(x, members=members)}
    assert nested.leaves(df.where("false"), ["k"], "doc").count() == 0


def test_changes_of_leaves(spark):
    old = {"a": 1, "gone": "x", "null": None, "lines": [{"n": "one", "v": 1}, {"n": "two", "v": 2}], "same": [1, {"z": 2}], "e": [], "o": [1]}
    new = {"a": "1", "came": "y", "lines": [{"n": "new", "v": 0}, {"n": "two", "v": 3}, {"n": "one", "v": 1}], "same": [1, {"z": 2}], "e": [{}, 4], "o": {}}
    x, y = (nested.leaves(spark.createDataFrame([(1, json.dumps(v))], "k int, doc string"), ["k"], "doc", {"lines": "n"}) for v in (old, new))
    got = {tuple(r)[1:] for r in nested.leaf_changes(x, y, ["k"]).collect()}
    assert got == {("/a", "changed", "1", "1"), ("/gone", "removed", "x", None), ("/came", "added", None, "y"), ("/lines/new/n", "added", None, "new"), ("/lines/new/v", "added", None, "0"), ("/lines/two/v", "changed", "2", "3"), ("/e/1", "added", None, "4"), ("/o/0", "removed", "1", None)}


@pytest.mark.parametrize("steps", [1, 2, 12])
@pytest.mark.parametrize("depth", [None, 30])
def test_leaves_of_any_depth(spark, monkeypatch, steps, depth):
    """Documents deeper than one plan's steps; brackets and quotes in texts; lists of nulls and of nothing."""
    monkeypatch.setattr(nested, "STEPS", steps)
    deep = [None]
    for k in range(13):
        deep = [k, {"x": deep}] if k % 2 else [deep, {}]
    documents = [*DOCUMENTS, deep, ["[[[", "\\", '"{', {"]": '\\"['}], [[], [None], [[None]], {"a": None}]]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(documents)] + [(90, "[" * 50)], "pos long, doc string")
    got = [tuple(r) for r in nested.leaves(df, ["pos"], "doc", depth=depth).collect()]
    want = {(i, *leaf) for i, x in enumerate(documents) for leaf in plain_leaves(x)}
    assert len(got) == len(want) and set(got) == want
    if depth is None:
        assert nested.depth_of(df, "doc") == 20
    else:
        with pytest.raises(Exception, match="deeper than 3"):
            nested.leaves(df, ["pos"], "doc", depth=3).collect()


def test_changes_of_documents_of_a_row(spark, monkeypatch):
    """The same changes as those of leaves, also where a pointer is there twice; nothing is written, and dealt rows aren't moved."""
    monkeypatch.setattr(nested, "kept", lambda *_: pytest.fail("a level was written"))
    versions = [*DOCUMENTS, {"lines": [{"n": "a", "v": 1}, {"n": "a", "v": 2}]}, {"lines": [{"n": "a", "v": 2}, {"n": "a", "v": 3}, {"n": "c"}]}, {}, None]
    texts = [None if v is None else json.dumps(v) for v in versions]
    df = spark.createDataFrame([(len(texts) * i + j, x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)], "k long, old string, new string").repartition(5, "k")
    got = nested.document_changes(df, ["k"], "old", "new", {"lines": "n"})
    x, y = (nested.leaves(df, ["k"], c, {"lines": "n"}) for c in ("old", "new"))
    assert sorted(map(str, got.collect())) == sorted(map(str, nested.leaf_changes(x, y, ["k"]).collect()))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_gates_before_a_start(spark):
    rows = spark.createDataFrame([(True, 0, 9, 0, 9, "paused"), (False, 9, 9, 0, 9, "own cap"), (False, 1, None, 0, 9, "own cap"), (False, 0, 9, 10, 9, "total cap"), (False, 0, 9, 0, 9, "go")], "p boolean, o int, oc int, s int, sc int, want string")
    got = rows.withColumn("got", gates.gate(*(F.col(c) for c in ("p", "o", "oc", "s", "sc"))))
    assert got.where("got <> want").count() == 0
