"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's shingles of five words, as big-endian 64-bit integers in order;
fewer than k mean that it holds them all. The sketch of a union is the k smallest of both, so parts of a corpus merge
in any order; resemblance, containment and the number of distinct shingles come from sketches alone. Texts without
words have an empty sketch; two empty sketches resemble each other fully. A very long text's hashes are held at once, 8
bytes a word; equal hashes count once; no documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, pieces, raw, shingle_hashes

K, WIDTH = 128, 5
_RANGE = 2.0**64


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 4 * k:  # a repeated hash may stand k times among the smallest, so widen until k are distinct
        take = 2 * k
        while take < len(hashes):
            low = np.unique(np.partition(hashes, take)[:take])
            if len(low) >= k:
                return low[:k]
            take *= 4
    return np.unique(hashes)[:k]


def sketch(text: bytes, k: int = K, width: int = WIDTH) -> np.ndarray:
    return bottom(shingle_hashes(text, width), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both; exact while both sketches hold all their shingles."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _RANGE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint and n_distinct (estimated distinct shingles) of every row; one pass without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            own = [sketch(t, k, width) for t in raw(batch, "text")]
            yield {"doc_id": batch.column(0), "fingerprint": [to_string(x) for x in own], "n_distinct": [distinct(x, k) for x in own]}

    return by_batch(documents(docs), work, "doc_id long, fingerprint string, n_distinct double")


def merged(prints: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """One sketch for each value of keys from rows with a fingerprint: the k smallest hashes, found by Spark.

    Each partition passes on k hashes of a key at most, so a key that holds most rows costs no more than another.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            *names, prints_ = (c.to_pylist() for c in batch.columns)
            for key, s in zip(zip(*names, strict=True) if names else [()] * batch.num_rows, prints_, strict=True):
                held[key] = merge(held.get(key, np.zeros(0, np.uint64)), from_string(s), k)
                if len(held) >= 1 << 14:
                    yield out(held)
                    held = {}
        yield out(held)

    def out(held: dict) -> dict:
        flat = [(*key, (h - (1 << 63))) for key, a in held.items() for h in a.tolist()]
        return dict(zip([*keys, "h"], zip(*flat, strict=True), strict=True)) if flat else {x: [] for x in [*keys, "h"]}

    kinds = dict(prints.dtypes)
    rows = by_batch(prints.select(*keys, "fingerprint"), work, ", ".join([*(f"`{x}` {kinds[x]}" for x in keys), "h long"])).distinct()
    kept = rows.withColumn("at", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("h"))).where(F.col("at") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias("hashes"))  # k values a key


def neighbours(docs: DataFrame, least_rows: int = 256) -> DataFrame:
    """Rows (bucket, guest, doc_id, text), to be read in descending doc_id order within a bucket.

    Ids are cut into four ranges for each shuffle partition, of least_rows at least; the row that follows a bucket's last one, found from the buckets'
    largest ids, goes to that bucket as its guest. The texts are shuffled once and whole; no window runs over all rows.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    ids = docs.select("doc_id").where("doc_id is not null")
    n = ids.count()
    n_buckets = max(1, min(-(-n // least_rows), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted({int(x) for x in (ids.approxQuantile("doc_id", [k / n_buckets for k in range(1, n_buckets)], 0.2 / n_buckets) if n_buckets > 1 else [])})
    bounds = np.array(cuts, np.int64)

    def place(batches: Iterator[pa.RecordBatch], text: bool = True) -> Iterator[dict]:
        for batch in batches:
            value = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            bucket = len(bounds) - np.searchsorted(bounds, value, side="left")  # the largest ids come first
            yield {"bucket": bucket, "doc_id": batch.column(0)} | ({"text": batch.column(1)} if text else {})

    thin = by_batch(docs.select("doc_id"), lambda b: place(b, False), "bucket int, doc_id long")
    heads = sorted(((r["bucket"], r["top"]) for r in thin.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()))  # a row a bucket
    used = [b for b, _ in heads]
    before = {top: used[i - 1] for i, (_, top) in enumerate(heads)}  # of the first bucket: the last, for the row after the end

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in place(batches):
            yield part | {"guest": np.zeros(len(part["bucket"]), bool)}
            ids_ = part["doc_id"].to_pylist()
            at = [i for i, x in enumerate(ids_) if x in before]
            if at:
                yield {"bucket": [before[ids_[i]] for i in at], "doc_id": [ids_[i] for i in at], "text": part["text"].take(pa.array(at)), "guest": [True] * len(at)}

    dealt = by_batch(docs, deal, "bucket int, doc_id long, text string, guest boolean")
    return dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each text's fingerprint and likeness to an edited form and to the next document, by descending doc_id.

    The edited form ends with the first floor(n / 2) characters of the next document (or all of it) in place of its own
    last floor(n / 2). After the last document comes the first. Repeated ids follow each other by text; null ids come
    last; null and empty texts have empty sketches. A task holds two texts at a time beside its Arrow batch.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        waiting: tuple | None = None  # bucket, doc_id, text, sketch

        def result(row: tuple, text: str, own: np.ndarray) -> tuple:
            n = len(row[2])
            edited = (row[2][: n - n // 2] + text[: n // 2]).encode()
            e = sketch(edited, k, width)
            return row[1], n, hashlib.sha256(edited).hexdigest(), to_string(row[3]), to_string(e), resemblance(row[3], e, k), resemblance(row[3], own, k)

        for batch in (x for b in batches for x in pieces(b)):
            rows = []
            for bucket, doc_id, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sketch(text.encode(), k, width)
                if waiting and waiting[0] == bucket:
                    rows.append(result(waiting, text, own))
                waiting = None if guest else (bucket, doc_id, text, own)
            yield dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

    return by_batch(neighbours(docs).select("bucket", "doc_id", "text", "guest"), work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
