"""Content-addressed store of token ids.

A document's id stream is cut where a rolling hash over its last ids meets a mask, so equal passages give equal chunks
wherever they stand. A chunk is named by the BLAKE2b digest of its bytes and stored once; a document's recipe lists its
chunks; the root of a Merkle tree over them is its manifest. Reading verifies each chunk against its name and each
recipe against its root, and takes a document's checksum from its chunks' (checksums of concatenations combine), so no
ids move between machines when the store is read.

Layout below the path: chunks (key, data); recipes (doc_id, n_tokens, names, lengths, root, part, place, within) in
ascending doc_id order, part and place being their order and within the ids before a row in its part; starts (part,
before), the ids of all parts before. Ids are kept as 16-bit little-endian integers where the vocabulary allows, else 32.

Texts are read once; a chunk leaves a task once, and is shuffled by its name, so a passage that most documents share
costs no more than a task's number of rows; when recipes meet their chunks, chunks that hold a large share of all
references are salted. Null and empty texts are the end id alone; null ids come first; equal ids and texts have a recipe
each; a very long text is one recipe, whose chunks a task holds. No documents give no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, mixed, new_path, pieces, salted_join
from sorrel.llm.encoding import LibraryEncoder, kept_encoder

#: The rolling hash sees WINDOW ids; chunks have LEAST to MOST ids, and AVERAGE more than LEAST on average.
WINDOW, LEAST, AVERAGE, MOST = 16, 64, 256, 1024


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(names: list[bytes]) -> bytes:
    """Root of the binary tree over names; an odd last node goes up alone. Leaves and nodes hash apart."""
    level = [digest(b"\0" + x) for x in names]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


def rolling_hash(ids: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """At each place a hash of the last WINDOW ids alone: a sum of their mixed values, each shifted by its distance.

    table: id_values of the vocabulary, so that an id's value is looked up. The window is built up by doubling.
    """
    out = id_values(ids) if table is None else table[ids]
    with np.errstate(over="ignore"):
        width = 1
        while width < WINDOW:
            out[width:] += out[:-width] << np.uint64(width)
            width *= 2
    return out >> np.uint64(WINDOW)


def id_values(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def hits(hashes: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end."""
    return np.flatnonzero((hashes & np.uint64(AVERAGE - 1)) == 0) + 1


def cut_points(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of one document of n ids; places: its hits."""
    at, ends = 0, []
    for hit in places:
        if hit < WINDOW:
            continue
        while hit - at > MOST:
            at += MOST
            ends.append(at)
        if hit - at >= LEAST and hit < n:
            at = hit
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n] if n > at else ends


def write_store(docs: DataFrame, tokenizer: str, path: str, end: int = 1, vocabulary: int = 49408) -> None:
    """Encodes every document, appends the end id, and writes chunks, recipes and manifests below path."""
    spark = docs.sparkSession
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = kept_encoder(LibraryEncoder, tokenizer)
        encoder.words.most = 1 << 17  # of words that come again, more are still there
        encode = encoder.encode_column
        table = id_values(np.arange(vocabulary))
        seen: set[bytes] = set()
        for batch in (x for b in batches for x in pieces(b)):
            ids, ends = encode(batch.column(1))
            ids = np.insert(ids, ends, end)
            ends = ends + np.arange(1, len(ends) + 1)
            small = ids.astype(kind)
            places = hits(rolling_hash(ids, table))
            cuts = np.searchsorted(places, ends, side="right").tolist()
            data, width, places = small.tobytes(), small.itemsize, places.tolist()
            out: dict[str, list] = {k: [] for k in ("kind", "key", "doc_id", "n_tokens", "names", "lengths", "root", "data")}
            start, low = 0, 0
            for doc_id, stop, high in zip(batch.column(0).to_pylist(), ends.tolist(), cuts, strict=True):
                own = cut_points(stop - start, [p - start for p in places[low:high]])
                chunks = [data[width * (start + a) : width * (start + b)] for a, b in zip([0, *own], own, strict=False)]
                names = [digest(c) for c in chunks]
                for name, chunk in zip(names, chunks, strict=True):
                    if name not in seen:
                        if len(seen) >= 1 << 17:
                            seen.clear()
                        seen.add(name)
                        for column, value in zip(out.values(), ("chunk", name, None, None, None, None, None, chunk), strict=True):
                            column.append(value)
                lengths = np.diff([0, *own]).astype("<u4").tobytes()
                for column, value in zip(out.values(), ("recipe", None, doc_id, stop - start, b"".join(names), lengths, merkle_root(names), None), strict=True):
                    column.append(value)
                start, low = stop, high
            yield out

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, before, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            sums = before + np.cumsum(n)
            yield {f: batch.column(i) for i, f in enumerate(("doc_id", "n_tokens", "names", "lengths", "root"))} | {"part": np.full(len(n), part), "place": (part << 33) + place + np.arange(len(n)), "within": sums - n}
            before, place = int(sums[-1]) if len(n) else before, place + len(n)

    rows = by_batch(documents(docs), work, "kind string, key binary, doc_id long, n_tokens long, names binary, lengths binary, root binary, data binary")
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/parts")
    once = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    _part(spark, path, "chunk", "key binary, data binary").withColumn("_once", once).where("_once = 1").drop("_once").write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = _part(spark, path, "recipe", "doc_id long, n_tokens long, names binary, lengths binary, root binary")
    ordered = recipes.repartitionByRange(F.col("doc_id"), F.col("root")).sortWithinPartitions("doc_id", "root")
    schema = "doc_id long, n_tokens long, names binary, lengths binary, root binary, part long, place long, within long"
    by_batch(ordered, numbered, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    totals = _recipes(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    before.write.parquet(f"{path}/starts")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, names binary, lengths binary, root binary, part long, place long, within long").parquet(f"{path}/recipes")


def started(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with start, the ids of all documents before."""
    starts = spark.read.schema("part long, before long").parquet(f"{path}/starts")  # a row a partition
    return _recipes(spark, path).join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("within"))


def _part(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, kind string").parquet(f"{path}/parts").where(F.col("kind") == kind).drop("kind")


@lru_cache(maxsize=64)
def _crc_shift(power: int) -> np.ndarray:
    """What 2^power further bytes make of a CRC-32, a linear map over GF(2), as a table for each of its four bytes."""
    if power:
        columns = _shifted(_shifted(np.uint32(1) << np.arange(32, dtype=np.uint32), _crc_shift(power - 1)), _crc_shift(power - 1))
    else:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            columns = columns >> np.uint32(1) ^ np.where(columns & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
    return np.array([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)], np.uint32)


def _shifted(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


def crc32_runs(crc: np.ndarray, n_bytes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations from those of their parts and the parts' numbers of bytes; first: where each one's parts begin, of one part at least."""
    out, sizes = crc.astype(np.uint32), np.diff(np.append(first, len(crc)))
    ends = np.cumsum(n_bytes.astype(np.int64))
    after = np.repeat(ends[first + sizes - 1], sizes) - ends  # bytes that follow a part
    power = 0
    while after.any():
        at = np.flatnonzero(after & 1)
        out[at] = _shifted(out[at], _crc_shift(power))
        after >>= 1
        power += 1
    return np.bitwise_xor.reduceat(out, first) if len(first) else np.zeros(0, np.uint32)


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from the (CRC-32, number of bytes) of its parts."""
    return int(crc32_runs(*np.array(parts, np.int64).T, np.zeros(1, np.int64))[0]) if parts else 0


def read_documents_back(spark: SparkSession, path: str, vocabulary: int = 49408) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified of every document, from the files alone."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids = [np.frombuffer(x, kind).astype("<u4") for x in data]
            yield {"key": keys, "n": [len(x) for x in ids], "crc": [zlib.crc32(x.tobytes()) for x in ids], "good": [digest(x) == k for k, x in zip(keys, data, strict=True)]}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            place, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield {"place": [p for p, n in zip(place, names, strict=True) for _ in range(len(n) // 16)], "at": [k for n in names for k in range(len(n) // 16)], "key": [n[k : k + 16] for n in names for k in range(0, len(n), 16)]}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n_tokens, roots, lists = batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4)
            cuts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            _, key, n, crc, good = lists.flatten().flatten()
            n, good, first = n.fill_null(0).to_numpy(), good.to_numpy(zero_copy_only=False), cuts[:-1]
            names = key.to_pylist()
            right = np.array([merkle_root(names[a:b]) == r for a, b, r in zip(cuts[:-1].tolist(), cuts[1:].tolist(), roots, strict=True)], bool)
            if len(first):
                right &= np.logical_and.reduceat(good, first) & (np.add.reduceat(n, first) == n_tokens)
            yield {"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2), "ids_crc32": crc32_runs(crc.fill_null(0).to_numpy(), 4 * n, first).astype(np.int64), "verified": right}

    known = by_batch(_chunks(spark, path), chunks, "key binary, n long, crc long, good boolean")
    recipes = started(spark, path)
    refs = by_batch(_recipes(spark, path).select("place", "names"), listed, "place long, at int, key binary")
    parts = salted_join(refs, known, "key", "left").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("at", "key", "n", "crc", F.coalesce("good", F.lit(False)).alias("good")))).alias("parts"))
    rows = recipes.select("place", "doc_id", "start", "n_tokens", "root").join(parts, "place")
    return by_batch(rows.select("doc_id", "start", "n_tokens", "root", "parts"), joined, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, data binary").parquet(f"{path}/chunks")


def read_ids(spark: SparkSession, path: str, vocabulary: int = 49408) -> DataFrame:
    """doc_id, start and ids (an array) of every document, put together from its chunks."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    recipes = started(spark, path)
    refs = _recipes(spark, path).select("place", F.explode(F.sequence(F.lit(0), (F.length("names") / 16).cast("int") - 1)).alias("at"), "names").select("place", "at", F.expr("substring(names, at * 16 + 1, 16)").alias("key"))
    whole = salted_join(refs, _chunks(spark, path), "key").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["data"] for p in parts), kind).astype(np.int64) for parts in batch.column(2).to_pylist()]
            yield {"doc_id": batch.column(0), "start": batch.column(1), "ids": pa.array(ids, pa.list_(pa.int64()))}

    return by_batch(recipes.join(whole, "place").select("doc_id", "start", "parts"), joined, "doc_id long, start long, ids array<bigint>")


def store_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a store in the shared folder and returns what reading it gives."""
    path = new_path(docs.sparkSession, "tokens")
    write_store(docs, tokenizer, path)
    return read_documents_back(docs.sparkSession, path)
