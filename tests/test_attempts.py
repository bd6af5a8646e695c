"""Streams over several micro-batches: late rows, repeats, retries, restarts."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from sorrel.operators import gates
from sorrel.streaming import attempts, windows

DAY = datetime.datetime(2024, 1, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, gates.STATE_STORE)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_late_rows_are_dropped_and_counted(spark):
    rows = [(0, at(1), 1), (0, at(2), 1), (1, at(100), 1), (2, at(101), 1), (3, at(3), 9), (3, at(102), 1)]  # the fifth comes days after its window has closed
    stream = windows.staged(spark.createDataFrame(rows, "b int, at timestamp, v int"), "b", range(4))
    told: dict = {}
    got = windows.settled(windows.by_window(stream, "at", "1 day", "1 day", [], {"n": F.count("*"), "v": F.sum("v")}), ["start"], told)
    assert {(r["start"], r["n"], r["v"]) for r in got.collect()} == {(at(0), 2, 2), (at(96), 3, 3)}
    assert told == {"batches": 4, "dropped": 1}


def test_repeats_over_batches(spark, tmp_path):
    rows = [(0, "a", at(0)), (0, "b", at(1)), (1, "a", at(2)), (1, "c", at(2)), (2, "c", at(5)), (2, "d", at(5))]
    stream = windows.staged(spark.createDataFrame(rows, "b int, url string, at timestamp"), "b", range(3))
    q = attempts.first_seen(stream, "url", "at", "10 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["url"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", at(0)), ("b", at(1)), ("c", at(2)), ("d", at(5))]


FETCHES = [
    (0, "ok", at(0), "ok"), (0, "slow", at(0), "transient"), (0, "bad", at(0), "broken"), (0, "gone", at(0), "transient"),
    (1, "ok", at(30), "transient"), (1, "slow", at(30), "ok"), (1, "gone", at(30), "transient"), (1, "late", at(31), "transient"),
    (2, "bad", at(60), "ok"), (2, "gone", at(60), "transient"), (2, "gone", at(61), "transient"), (3, "x", at(200), "ok"), (3, None, at(200), "ok"),
]


def test_fetches_over_batches_and_a_restart(spark, tmp_path, state_store):
    """The stream is stopped after each micro-batch and goes on from its checkpoint."""
    schema = "url string, at timestamp, outcome string"
    for batch in range(4):
        spark.createDataFrame([r[1:] for r in FETCHES if r[0] == batch], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        states = attempts.fetch_states(stream, "url", "at", "outcome", 3, "10h", "1 hour")
        states.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["url"], r["status"], r["tries"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        ("ok", "ingested", 0, at(0)), ("slow", "waiting", 1, at(0)), ("bad", "failed", 0, at(0)), ("gone", "waiting", 1, at(0)),
        ("slow", "ingested", 1, at(30)), ("gone", "waiting", 2, at(30)), ("late", "waiting", 1, at(31)), ("late", "retry", 1, at(41)),
        ("bad", "ingested", 0, at(60)), ("gone", "failed", 3, at(60)), ("gone", "failed", 4, at(61)), ("x", "ingested", 0, at(200)),
    }
