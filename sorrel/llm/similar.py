"""Operator 8 over similarity: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more, and groups.

Candidates come from operator 8's fingerprints and from keys of least hashes; all are compared on the exact sets, so
nothing is linked by an estimate. Equal sets are collapsed first.

- SimHash: the documents that links of at most 4 differing bits of their 64 connect (by covering anchors, as in
  simhash.py) are candidates of each other. It finds the closest copies alone: fingerprints of sets with a similarity of
  0.8 differ in about 10 bits, for which covering anchors would need thousands of replicas a fingerprint.
- So each distinct set has BANDS keys as well, each over ROWS least hashes; sets that share a key are a bucket. A pair
  with a similarity of s shares one of the keys with a probability of 1 - (1 - s ** ROWS) ** BANDS: of pairs at 0.8 about
  three in a million are missed, and fewer above.

Each set of a bucket is compared with the bucket's first one, which connects those that it links. What the links of all
buckets together don't connect with its bucket's first set meets all sets of the bucket, in chunks, each two of which are
a group of their own, so what a task holds is the sets of two chunks at most. Pairs that are connected already aren't compared, so a large group of near copies costs in proportion to its
size. A group returns a forest of its links, never all its pairs. Sizes alone tell many pairs apart before a set moves.

A set is compared by 32 bits of each shingle's hash, so two different shingles of a pair are taken for one with a chance
of one in four thousand million. Sets are made in a second scan, only of texts that a map of bits doesn't rule out, and
move for the distinct pairs with first sets alone, not for each key.

Null and empty texts have the empty set and are one group; a text of fewer words than a shingle is one shingle; a very
long text's hashes are held at once, 8 bytes a word; repeated rows share a group; no documents give no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm import simhash
from sorrel.llm.common import Bits, by_batch, documents, frequent, hot_values, mixed, pieces, raw, salted_join, shingle_hashes, spread, stored
from sorrel.llm.simhash import components, connected

WIDTH, BANDS, ROWS, CHUNK = 5, 32, 5, 256
_FLIP = -(1 << 63)  # turns the order of unsigned integers into that of signed ones
_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def set_id(shingles: np.ndarray) -> int:
    """A hash of a set of shingles: 0 for the empty one."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0]) if len(shingles) else 0


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles, none for the empty one."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        low = np.minimum(low, ((short[i : i + 1024, None] ^ _XOR) * _TIMES).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[k::ROWS])
    return key


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the id of the set of shingles, its size, its SimHash and its band keys, of every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            texts = raw(batch, "text")
            sets = [np.unique(shingle_hashes(t, WIDTH)) for t in texts]
            with np.errstate(over="ignore"):
                keys = [band_keys(s).view(np.int64) for s in sets]
            yield {"doc_id": batch.column(0), "th": text_hashes(texts), "size": [len(s) for s in sets], "fp": np.array([set_id(s) for s in sets], np.uint64).view(np.int64), "sim": np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64), "keys": keys}

    return by_batch(documents(docs), work, "doc_id long, th long, size int, fp long, sim long, keys array<bigint>")


def text_hashes(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t, 11) for t in texts], np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """fp, the set's id, and data, its bytes, for needed (fp, th: the hash of one text that has the set)."""

    some_need = Bits(needed, "th")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            texts = raw(batch, "text")
            th = text_hashes(texts)
            at = np.flatnonzero(some_need(th))
            sets = (np.unique((shingle_hashes(texts[i], WIDTH) >> np.uint64(32)).astype(np.uint32)) for i in at.tolist())
            yield {"th": th[at], "data": [s.tobytes() for s in sets]}

    some = by_batch(documents(docs), work, "th long, data binary")
    return needed.join(some.groupBy("th").agg(F.first("data").alias("data")), "th").select("fp", "data")


def linked(sets: list[np.ndarray], tenths: int = 8) -> np.ndarray:
    """For each set the index of the smallest one that links connect it with; a link is a Jaccard similarity of tenths / 10 or more."""
    sizes, n = np.array([len(s) for s in sets], np.int64), len(sets)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    common = times[column] > 1
    row, column = row[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    width = max(1024, (1 << 22) // n)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        m = np.zeros((n, min(width, int(column[-1]) + 1 - start)), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        both += m @ m.T
    i, j = np.nonzero(np.triu((10 + tenths) * both.astype(np.int64) >= tenths * (sizes[:, None] + sizes[None, :]), 1))
    return connected(np.arange(n), i, j)


def edges(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of linked sets, u > v as unsigned, that connect what links connect."""
    first = [F.first("sim").alias("sim"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.min("th").alias("th")]
    distinct = stored(spread(rows.where("size > 0"), rows.count(), "fp").groupBy("fp").agg(*first), "sets-by-id")
    sims = stored(distinct.select(F.col("sim").alias("fp")).distinct(), "simhashes")
    close = components(simhash.edges(sims)).select(F.col("fp").alias("sim"), "root")
    root = F.xxhash64(F.coalesce("root", "sim"), F.lit("simhash"))
    keyed = distinct.join(close, "sim", "left").select("fp", "size", F.explode(F.concat("keys", F.array(root))).alias("key"))
    keyed = stored(keyed, "keyed")
    # A bucket is a key with its number of sets, its first set and two sums that tell sets of sets apart; the same sets
    # meet in many bands, and one of those buckets is kept.
    sums = [F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit("again"))).alias("y")]
    buckets = keyed.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.min(F.struct("fp", "size")).alias("pivot"), *sums).where("n > 1")
    buckets = stored(buckets.groupBy("n", "pivot", "x", "y").agg(F.min("key").alias("key")).select("key", "n", F.col("pivot.fp").alias("pivot"), F.col("pivot.size").alias("pivot_size")), "buckets")
    members = stored(salted_join(Bits(buckets, "key").rows(keyed, "key"), buckets, "key").withColumnRenamed("key", "bucket"), "members")
    needed = stored(members.select("fp").distinct().join(distinct.select("fp", "th"), "fp"), "needed")
    sets = stored(shingle_sets(docs, needed), "sets")
    # Each set against the first of its bucket: near copies have the same first set in most bands, so these are few pairs
    # for each set. Those that it links are connected by it; the others alone must meet all members of the bucket.
    pairs = stored(members.where("fp <> pivot").select("fp", "pivot", (5 * F.least("size", "pivot_size") >= 4 * F.greatest("size", "pivot_size")).alias("fits")).distinct(), "pairs")
    firsts = sets.select(F.col("fp").alias("pivot"), F.col("data").alias("pivot_data"))
    hot = hot_values(members.agg(*frequent("pivot")).first(), "pivot")
    met = salted_join(pairs.where("fits").drop("fits").join(sets, "fp"), firsts, "pivot", hot=hot, salt=F.xxhash64("fp"))

    def against_first(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                near.append(18 * len(np.intersect1d(x, y, assume_unique=True)) >= 8 * (len(x) + len(y)))
            yield {"fp": batch.column(0), "pivot": batch.column(1), "near": near}

    tested = stored(by_batch(met.select("fp", "pivot", "data", "pivot_data"), against_first, "fp long, pivot long, near boolean"), "tested")
    u, v = (F.col(c).bitwiseXOR(F.lit(_FLIP)) for c in ("fp", "pivot"))
    by_first = tested.where("near").select(F.greatest(u, v).bitwiseXOR(F.lit(_FLIP)).alias("u"), F.least(u, v).bitwiseXOR(F.lit(_FLIP)).alias("v"))
    by_first = stored(by_first.distinct(), "links")
    # Links with the first sets of all buckets connect most of a group; in a bucket only sets that they don't connect with
    # its first one, by whatever way, must meet the others.
    known = stored(components(by_first).select("fp", "root"), "known")
    rooted = members.where("n > 2 and fp <> pivot").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_first = known.select(F.col("fp").alias("pivot"), F.col("root").alias("pivot_root"))
    rooted = salted_join(rooted, of_first, "pivot", "left", hot=hot, salt=F.xxhash64("fp"))
    apart = stored(rooted.where(F.col("root") != F.coalesce("pivot_root", "pivot")).select("bucket", "fp", "n"), "apart")
    parts = apart.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    alone = salted_join(apart, parts, "bucket").select("bucket", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("b"), "fp")
    every = salted_join(members, parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a"), F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks).cast("int").alias("b"), "fp")
    groups = alone.unionByName(every).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def settled() -> dict:
            label = linked(held)
            moved = np.flatnonzero(label != np.arange(len(label)))
            u, v = np.array(ids, np.int64).view(np.uint64)[moved], np.array(ids, np.int64).view(np.uint64)[label[moved]]
            return {"u": np.maximum(u, v).view(np.int64), "v": np.minimum(u, v).view(np.int64)}

        last, ids, held, out = None, [], [], {"u": [], "v": []}
        for batch in batches:
            for bucket, a, b, fp, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (bucket, a, b):
                    if held:
                        for k, v in settled().items():
                            out[k].extend(v.tolist())
                    last, ids, held = (bucket, a, b), [], []
                ids.append(fp)
                held.append(np.frombuffer(data, np.uint32))
            yield out
            out = {"u": [], "v": []}
        if held:
            yield settled()

    dealt = groups.join(sets, "fp").select("bucket", "a", "b", "fp", "data").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return by_batch(dealt, compare, "u long, v long").unionByName(by_first).distinct()


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id of the component, null where all are null) of every row."""
    rows = stored(fingerprints(docs), "shingled")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    named = stored(distinct.join(components(edges(docs, rows)), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = salted_join(named, lows, "root").select("fp", "component_id")
    return salted_join(rows.select("doc_id", "fp"), by_fp, "fp").select("doc_id", "component_id")
