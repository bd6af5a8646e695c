"""Best-fit packing: best-two-fit over the histogram of lengths.

A document's ids, with an end id, are cut into pieces of the sequence length (the first one shorter) only if they are
longer. A sequence is filled greedily with the longest piece that fits; then its smallest piece is replaced by the two
that fill the widened gap more tightly, if two such remain.

Pieces of equal length are interchangeable, so the plan is made on counts by length: at most `size` numbers whatever the
corpus, and each step is repeated as often as the counts allow. The plan's size depends on `size` alone. Pieces are then
numbered within their length (a running number inside hash buckets of ids plus the buckets' totals before it) and take
their places from the plan. Null and empty texts are one piece, the end id; a very long text is cut into pieces;
repeated rows are packed each, and dealt over the buckets by their place in the table of pieces, so that rows that equal
each other wholly don't meet in one; no documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, pieces, stored
from sorrel.llm.encoding import LibraryEncoder, kept_encoder

SIZE, END = 1024, 2


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else full pieces after a first one of the rest."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; no shuffle."""
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = kept_encoder(LibraryEncoder, path).encode_column
        for batch in (x for b in batches for x in pieces(b, 1 << 21)):
            ids, ends = encode(batch.column(1))
            data = memoryview(np.insert(ids, ends, end).astype("<u4", copy=False).tobytes())
            rows, at = [], 0
            for doc_id, stop in zip(batch.column(0).to_pylist(), (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                for k, (s, n) in enumerate(cut(stop - at, size)):
                    rows.append((doc_id, k, s, n, zlib.crc32(data[4 * (at + s) : 4 * (at + s + n)])))
                at = stop
            yield dict(zip(names, zip(*rows, strict=True), strict=True))

    return by_batch(documents(docs), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Slots by length: the rank of the first piece, how many of that length a sequence takes, the first sequence, the offset."""

    slots: dict[int, list[tuple[int, int, int, int]]]
    n_sequences: int


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Plans sequences for so many pieces of each length (1 to size)."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(size + 1, np.int64)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    n_sequences = 0
    lengths = np.arange(size + 1)
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return Plan(slots, n_sequences)
        taken: dict[int, int] = {}
        gap, smallest = size, 0
        fit = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest that is left, up to each length
        while gap:
            length = int(fit[gap])
            while length and left[length] <= taken.get(length, 0):
                length = int(fit[length - 1])
            if not length:
                break
            n = min(gap // length, int(left[length]) - taken.get(length, 0))
            taken[length] = taken.get(length, 0) + n
            gap -= n * length
            smallest = length
        if gap and sum(taken.values()) > 1:  # more than one piece: try two for the smallest
            wide = gap + smallest
            free = left.copy()
            for length, n in taken.items():
                free[length] -= n
            fit = np.maximum.accumulate(np.where(free > 0, lengths, 0))
            a = np.flatnonzero(free[: wide + 1] > 0)
            a = a[a > 0]
            if len(a):
                b = fit[np.minimum(wide - a, a)]
                alone = (b == a) & (free[a] < 2)
                b[alone] = fit[np.maximum(a[alone] - 1, 0)]
                total = np.where(b > 0, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    taken[smallest] -= 1
                    for x in (int(a[best]), int(b[best])):
                        taken[x] = taken.get(x, 0) + 1
        taken = {k: n for k, n in taken.items() if n}
        times = min(int(left[k]) // n for k, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            n = taken[length]
            slots.setdefault(length, []).append((int(used[length]), n, n_sequences, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        n_sequences += times


def placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length and a rank (from 0) within it."""
    table = {k: (np.array([s[0] for s in v]), np.array([s[1] for s in v]), np.array([s[2] for s in v]), np.array([s[3] for s in v])) for k, v in plan.slots.items()}
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                first, each, base, at = table[int(k)]
                slot = np.searchsorted(first, rank[own], side="right") - 1
                step = rank[own] - first[slot]
                sequence[own] = base[slot] + step // each[slot]
                offset[own] = at[slot] + step % each[slot] * k
            yield {n: batch.column(i) for i, n in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))} | {"sequence_id": sequence, "offset": offset}

    return by_batch(rows.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), work, schema)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Every piece with its sequence_id and its offset there, gapless from 0."""
    spark = docs.sparkSession
    rows = stored(token_pieces(docs, path, size, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    plan = best_two_fit({r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}, size)  # at most `size` rows
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(buckets)))
    totals = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    return placed(ranked.withColumn("rank", (F.col("before") + F.col("own")).cast("long")), plan)
