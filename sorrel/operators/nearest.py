"""One-to-one assignment of two sides of a group by the distance of a number, the nearest pair first, without making the pairs.

On a line the nearest pair that is left always stands side by side: what lies between two rows is nearer to one of them.
So a group's line is cut into cells, and a cell takes its pairs in order from a heap of neighbours. What lies beyond a
cell's edge isn't known there: a row that is as far from its partner as from an edge stays open, and so does any row that
an open one might take before its own partner does. Open rows go on to cells that lie across the edges and grow, until
there are none of both sides.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.session import kept

#: A cell's width at first, times the distance of the least score. Edges move by half a cell, so what was near one comes to lie in the middle.
CELL = 8


def cell_pairs(value: np.ndarray, side: np.ndarray, key: np.ndarray, low: float, high: float, least: float) -> tuple[list, np.ndarray]:
    """(left key, right key, score) of pairs that hold whatever lies outside of low to high, and the places of rows that stay open."""
    order = np.lexsort((key, side, value))
    value, side, key = value[order], side[order], key[order]
    new_run = np.r_[True, (value[1:] != value[:-1]) | (side[1:] != side[:-1])]
    fresh = new_run | np.r_[True, key[1:] != key[:-1]]  # a row that repeats counts once
    order, value, side, key, new_run = order[fresh], value[fresh], side[fresh], key[fresh].tolist(), new_run[fresh]
    # Runs: rows of a side with the same value, used up from the smallest key on.
    first = np.flatnonzero(new_run)
    x, kind, n = value[first].tolist(), side[first].tolist(), len(first)
    at, end = first.tolist(), [*first[1:].tolist(), len(key)]
    before, after, is_open = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
    # For each side, from a place on to the left (-1) or right (1), where the next run may be that is neither open nor used up; n and -1: none.
    hop = {(k, step): [i if 0 <= i < n and kind[i] == k else i + step for i in range(-1, n + 1)] for k in (0, 1) for step in (-1, 1)}
    heap: list[tuple] = []

    def next_run(k: int, step: int, i: int) -> int:
        to, passed = hop[k, step], []
        while 0 <= i < n and to[i + 1] != i:
            passed.append(i)
            i = to[i + 1]
        for p in passed:
            to[p + 1] = i
        return i

    def gone(i: int) -> None:
        for step in (-1, 1):
            hop[kind[i], step][i + 1] = i + step

    def push(a: float, b: float, *event) -> None:
        score = 1 / (1 + abs(a - b))
        if score >= least:
            heapq.heappush(heap, (-score, *event))

    def meet(i: int, j: int) -> None:
        if i >= 0 and j < n and kind[i] != kind[j]:
            i, j = (i, j) if kind[i] == 0 else (j, i)
            push(x[i], x[j], 1, key[at[i]], key[at[j]], i, j)

    def reach_out(i: int, step: int) -> None:
        j = next_run(1 - kind[i], step, i)
        if 0 <= j < n:
            push(x[i], x[j], 0, i, step, j)

    # Of equal scores what opens a run comes before a pair, as a key outside may be smaller. An edge is a rounded number.
    slack = 1e-9 * max(abs(low), abs(high))
    for i in range(n):
        meet(i, i + 1)
        for edge in (low + slack, high - slack):
            push(x[i], edge, 0, i, 0, i)
    pairs = []
    while heap:
        score, real, *event = heapq.heappop(heap)
        if not real:
            i, step, j = event
            if at[j] < end[j] and not is_open[j]:
                is_open[j] = True
                gone(j)
                for s in (-1, 1):
                    reach_out(j, s)
            if step:
                reach_out(i, step)
            continue
        a, b, i, j = event
        if at[i] == end[i] or at[j] == end[j] or is_open[i] or is_open[j]:
            continue
        if a == key[at[i]] and b == key[at[j]]:  # else another run of the same distance took one of the two
            pairs.append((a, b, -score))
            at[i], at[j] = at[i] + 1, at[j] + 1
        for k in (i, j):
            if at[k] == end[k]:
                gone(k)
                p, q = before[k], after[k]
                if p >= 0:
                    after[p] = q
                if q < n:
                    before[q] = p
        i, j = min(i, j), max(i, j)
        # What stands side by side there now.
        meet(i if at[i] < end[i] else before[i], j if at[j] < end[j] else after[j])
    left = [order[at[i] : end[i]] for i in range(n) if is_open[i]]
    return pairs, np.concatenate(left) if left else np.zeros(0, np.int64)


def nearest_pairs(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str, value: tuple[str, str], least: float) -> DataFrame:
    """group, left_key, right_key, score of one-to-one pairs: 1 / (1 + distance of the values) from least on, best first, ties by left and right key.

    value: the column of either side. Whole numbers as keys, each with one value in its group; rows that repeat count
    once. Null groups and keys and values that are no finite numbers have no partner. A task holds cells of groups.
    """
    kind = dict(left.dtypes)[group]

    def rows(df: DataFrame, key: str, column: str, side: int) -> DataFrame:
        own = df.select(group, F.lit(side).alias("side"), F.col(key).cast("bigint").alias("key"), F.col(column).cast("double").alias("value"), F.lit(None).cast("bigint").alias("other"))
        return own.where(F.col(group).isNotNull() & F.col("key").isNotNull() & (F.abs("value") < float("inf")))

    rest = rows(left, left_key, value[0], 0).unionByName(rows(right, right_key, value[1], 1))
    schema = f"{group} {kind}, side int, key bigint, value double, other bigint"

    def one_round(rest: DataFrame, width: float, offset: float) -> DataFrame:
        def work(keys: tuple, table: pa.Table) -> pa.Table:
            number = keys[1].as_py()
            values, sides, ids = (table[c].to_numpy() for c in ("value", "side", "key"))
            pairs, again = cell_pairs(values, sides, ids, number * width - offset, (number + 1) * width - offset, least)
            a, b, score = (pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))
            taken = pa.table([pa.array([keys[0].as_py()] * len(pairs), table.schema.field(group).type), pa.nulls(len(pairs), pa.int32()), a, score, b], names=[group, "side", "key", "value", "other"])
            return pa.concat_tables([taken, table.select(taken.column_names).take(pa.array(again)).cast(taken.schema)])

        return rest.withColumn("_cell", F.floor((F.col("value") + offset) / width)).groupBy(group, "_cell").applyInArrow(work, schema)

    width, done, moved = CELL / least, [], False
    while True:
        found = kept(one_round(rest, width, width / 2 if moved else 0.0), "nearest")
        done.append(found.where("side IS NULL").select(group, F.col("key").alias(left_key), F.col("other").alias(right_key), F.col("value").alias("score")))
        rest = found.where("side IS NOT NULL")
        if rest.select("side").distinct().count() < 2:
            return reduce(DataFrame.unionByName, done)
        width, moved = width * 2 if moved else width, not moved
