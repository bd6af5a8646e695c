"""Versions of tables: failures between any two steps, repeats, conflicts, logs, merges by parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sorrel.sources import versions as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


@pytest.mark.parametrize("step", ["data", "_write_manifest", "_publish", "after"])
def test_a_failure_between_steps_leaves_the_old_version(spark, path, monkeypatch, step):
    V.commit(spark, path, "first", replace={"a": frame(spark, (1, "x")), "b": frame(spark, (2, "y"))})

    def fail(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "data":
            bad = frame(spark, (9, "z")).select("k", F.raise_error(F.lit("lost")).cast("string").alias("v"))
        elif step == "after":  # the rename was done, but its caller never heard of it
            whole = V._publish
            m.setattr(V, "_publish", lambda *a: (whole(*a), fail()))
            bad = frame(spark, (4, "w"))
        else:
            m.setattr(V, step, fail)
            bad = frame(spark, (4, "w"))
        with pytest.raises(Exception, match="lost"):
            V.commit(spark, path, "second", replace={"a": frame(spark, (3, "n")), "b": bad})
    if step != "after":
        assert rows(V.read(spark, path, "a")) == [(1, "x")] and rows(V.read(spark, path, "b")) == [(2, "y")]
    number = V.commit(spark, path, "second", replace={"a": frame(spark, (3, "n")), "b": frame(spark, (4, "w"))})
    assert number == 2 and rows(V.read(spark, path, "a")) == [(3, "n")] and rows(V.read(spark, path, "b")) == [(4, "w")]
    assert rows(V.read(spark, path, "a", 1)) == [(1, "x")]
    V.vacuum(spark, path, 1)
    assert rows(V.read(spark, path, "b")) == [(4, "w")] and V._numbers(spark, path) == [2]


def test_a_commit_that_is_tried_again_changes_nothing(spark, path):
    for _ in range(3):
        assert V.commit(spark, path, "one", append={"ledger": frame(spark, (1, "a"))}, form="json") == 1
    assert V.commit(spark, path, "two", append={"ledger": frame(spark, (2, "b"))}, form="json") == 2
    assert rows(V.read(spark, path, "ledger")) == [(1, "a"), (2, "b")]
    for k in range(2):
        V.commit(spark, path, f"m{k}", append={"months": frame(spark, (k, "2024-01"), (k, "2024-02"))}, form="json", part_by="v")
    assert rows(V.read(spark, path, "months", parts=["2024-02"])) == [(0, "2024-02"), (1, "2024-02")] and V.read(spark, path, "months").count() == 4


def test_the_second_of_two_writers_gets_a_conflict(spark, path):
    V.commit(spark, path, "one", replace={"a": frame(spark, (1, "a"))})
    base = V.manifest(spark, path)
    V.commit(spark, path, "two", replace={"a": frame(spark, (2, "b"))})
    with pytest.raises(V.Conflict):
        V.commit(spark, path, "three", replace={"a": frame(spark, (3, "c"))}, base=base)
    assert rows(V.read(spark, path, "a")) == [(2, "b")] and V.manifest(spark, path)["version"] == 2


def test_upserts_log_old_and_new_values(spark, path):
    V.upsert(spark, path, "t", frame(spark, (1, "a"), (2, "b"), (3, "c"), (4, None)), ["k"], "one")
    V.upsert(spark, path, "t", frame(spark, (2, "B"), (3, "c"), (5, "e")), ["k"], "two", failed=frame(spark, (1, ""), (2, ""), (77, "")))
    V.upsert(spark, path, "t", frame(spark, (2, "B"), (3, "c"), (5, "e")), ["k"], "two", failed=frame(spark, (3, "")))  # tried again
    assert rows(V.read(spark, path, "t")) == [(2, "B"), (3, "c"), (4, None), (5, "e")]
    log = {(r["commit"], r["k"], r["change"], r["old"] and r["old"]["v"], r["new"] and r["new"]["v"]) for r in V.read(spark, path, "t_log").collect()}
    assert log == {("one", 1, "added", None, "a"), ("one", 2, "added", None, "b"), ("one", 3, "added", None, "c"), ("one", 4, "added", None, None), ("two", 1, "removed", "a", None), ("two", 2, "replaced", "b", "B"), ("two", 5, "added", None, "e")}


def test_a_merge_writes_touched_parts_alone(spark, path):
    V.upsert(spark, path, "t", spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")), ["k"], "one", parts=16)
    first = V.manifest(spark, path)["tables"]["t"]["parts"]
    V.upsert(spark, path, "t", frame(spark, (7, "y")), ["k"], "two", parts=16)
    second = V.manifest(spark, path)["tables"]["t"]["parts"]
    assert len(first) == 16 and sum(first[p] != second[p] for p in first) == 1
    got = V.read(spark, path, "t")
    assert got.count() == 1000 and got.where("v = 'y'").collect()[0]["k"] == 7


def test_before_the_first_commit(spark, path):
    assert V.manifest(spark, path)["version"] == 0
    with pytest.raises(KeyError):
        V.read(spark, path, "none")
