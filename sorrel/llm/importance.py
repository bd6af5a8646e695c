"""Target-distribution importance resampling: documents are drawn by how much likelier their word runs are in a target.

Features are all runs of one to `longest` consecutive words; a feature's bucket is the CRC-32 of its bytes modulo
`buckets`. One scan of a document keeps the running CRC states of the last `longest` starts in a ring: each word extends
every state by a space and itself and opens a state of its own, so no run is ever put together as a string. A bucket's
gain is the logarithm of its smoothed share in the target over that in the documents; a document's weight is the mean
gain of its features, its score adds Gumbel noise that follows from its id alone, and the highest scores are drawn: a
sample without replacement by importance weights.

Both passes are scans without a shuffle of texts: the first sends at most `buckets` counts a task, the second leaves one
short row a document. Gains are `buckets` numbers whatever the corpus. Ranks come from a range partitioning of those short
rows, numbered within and offset by the partitions' sizes; no task sorts all of them.

Null and empty texts have no features, weight 0 and no rank; a very long text is scanned in slices, so what is held is
its bytes and one slice's words; repeated rows count each time and are drawn each for itself, rows that tie in score and
id in any order; a null id has the noise of the empty string and comes last among ties; an empty target gives the gains
of an empty one; no documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, pieces, raw, stored

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def word_slices(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of those of about size bytes; a word is never cut."""
    text, at = text.lower(), 0
    while at < len(text):
        gap = _GAP.search(text, min(at + size, len(text)))
        end = gap.end() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def run_buckets(text: bytes, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each slice of a text its number of words and the buckets of the runs that end in it."""
    crc, ring = zlib.crc32, []  # ring: states of the runs that the next word extends, oldest first
    for words in word_slices(text):
        found: list[int] = []
        for word in words:
            tail = b" " + word
            ring = [crc(tail, state) for state in ring]
            ring.append(crc(word))
            found += ring
            if len(ring) == longest:
                del ring[0]
        yield len(words), np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all rows of texts (a column text) fall in each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros(buckets, np.int64)
        held, size = [], 0
        for found in (x for b in batches for t in raw(b, "text") for _, x in run_buckets(t, longest, buckets)):
            held.append(found)
            size += len(found)
            if size > 1 << 19:
                n += np.bincount(np.concatenate(held), minlength=buckets)
                held, size = [], 0
        if held:
            n += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(n)
        yield {"bucket": at, "n": n[at]}

    rows = by_batch(texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), work, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the source)) of each bucket, both smoothed by one."""
    b, t_all, s_all = len(target), float(target.sum()), float(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(1000 * g), g a Gumbel variate that follows from the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features, 0 without) and score of every row."""
    buckets = len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            ids, n_words, n_features, weight = batch.column(0).to_pylist(), [], [], []
            for text in raw(batch, "text"):
                words = features = total = 0
                for n, found in run_buckets(text, longest, buckets):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                n_words.append(words)
                n_features.append(features)
                weight.append(total // features if features else 0)
            yield {"doc_id": batch.column(0), "n_words": n_words, "n_features": n_features, "weight": weight, "score": [w + gumbel(i, seed) for i, w in zip(ids, weight, strict=True)]}

    return by_batch(documents(docs), work, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame) -> DataFrame:
    """rows (a stored table) with rank, 1 for the highest score, ties to the smaller doc_id and null ids last."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # splits rows that tie in both; the same when a task runs again
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = rows.columns[:-1]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield {c: batch.column(i) for i, c in enumerate(names)} | {"part": np.full(batch.num_rows, part), "place": n + 1 + np.arange(batch.num_rows)}
            n += batch.num_rows

    own = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    numbered = stored(by_batch(ordered, number, ", ".join([*own, "part long", "place long"])), "numbered")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    return numbered.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for what isn't drawn.

    Of the rows with at least least_words words, floor(percent / 100 of their number) are drawn.
    """
    gain = gains(bucket_counts(target, longest, buckets), bucket_counts(docs, longest, buckets))
    rows = stored(weigh(docs, gain, longest, seed), "weights")
    able = F.col("n_words") >= least_words
    drawn = percent * rows.where(able).count() // 100
    first = ranked(rows.where(able)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score"]
    return first.select(*columns, "rank").unionByName(rows.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
