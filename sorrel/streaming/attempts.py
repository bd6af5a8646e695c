"""Repeats and retries over many micro-batches: keys seen before, and what becomes of things that are fetched again and again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType


def first_seen(stream: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """The first row of each key that comes, as long as its time is known: a key's state goes when the watermark is `within` behind it."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


class _Fetches(StatefulProcessor):
    """A key's status and number of passing failures; a timer asks for the next try."""

    def __init__(self, key: str, at: str, outcome: str, most: int, wait_ms: int):
        self.key, self.at, self.outcome, self.most, self.wait_ms = key, at, outcome, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fetch", "status string, tries int, at timestamp")

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, "status", "tries", "at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        came = pd.concat(list(rows)).sort_values([self.at, self.outcome], kind="stable")  # a key's rows of one micro-batch
        status, tries, last = self.state.get() if self.state.exists() else (None, 0, None)
        out = []
        for at, outcome in zip(came[self.at], came[self.outcome], strict=True):
            if status == "ingested":
                continue  # what is there stays; a repeat tells nothing new
            if outcome == "ok":
                status = "ingested"
            elif outcome == "transient":
                tries += 1
                status = "failed" if tries >= self.most else "waiting"
            else:
                status = "failed"
            last = at
            out.append((status, tries, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "waiting":
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.wait_ms)
        self.state.update((status, tries, last.to_pydatetime() if hasattr(last, "to_pydatetime") else last))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        status, tries, _ = self.state.get()
        due = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield self._rows(key, [("retry", tries, due)] if status == "waiting" else [])

    def close(self) -> None:
        pass


def fetch_states(stream: DataFrame, key: str, at: str, outcome: str, most: int, wait: str, late: str) -> DataFrame:
    """key, status, tries, at of each change: ingested, failed, waiting after a passing failure, retry when it is due.

    outcome is `ok`, `transient` or anything else, which is a failure for good. What has failed may still be ingested
    later; what is ingested stays. After `most` passing failures a key has failed. A key that waits is due `wait` (a
    pandas time delta) after its last failure, told once the watermark, `late` behind the latest time, is past that; a new
    outcome before it puts the time off. Rows of a micro-batch count in the order of their times, batches as they come.
    Needs the state store of `sorrel.operators.gates.STATE_STORE`.
    """
    schema = StructType([stream.schema[key], StructField("status", StringType()), StructField("tries", IntegerType()), StructField("at", TimestampType())])
    processor = _Fetches(key, at, outcome, most, int(pd.Timedelta(wait).total_seconds() * 1000))
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, outcome).withWatermark(at, late)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
