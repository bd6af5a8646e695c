"""What the corpus operators share: the two columns they read, tables in the shared folder, cached word hashes."""

from __future__ import annotations

import atexit
import itertools
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_tables = itertools.count()
_run = uuid.uuid4().hex[:12]

#: White space of the Unicode property, which the tokenizers' patterns mean by \s (Python's re adds four controls).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Parts of a text between which the tokenizers' patterns always split: a word with the space before it, or white space.
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


class Kept:
    """Results by text, in two generations of bounded size: what was met lately outlives what was not."""

    def __init__(self, make, most: int = 1 << 16):
        self.make, self.most = make, most  # make: list of new texts -> their results
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, parts: list[list]) -> list[list]:
        """The results for each list of texts."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        met = {u for p in parts for u in set(p).difference(young)}
        new = [u for u in met if u not in old]
        young.update((u, old[u]) for u in met if u in old)
        young.update(zip(new, self.make(new), strict=True))
        return [list(map(young.__getitem__, p)) for p in parts]


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as an empty one; other columns, whatever their names, go no further."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """name with as many underlines before it as make it none of df's columns, however they are spelt."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; a temporary one on a single machine, as in tests.

    Without that setting a cluster has no folder that all its machines share, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sorrel-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this run, in whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before; its owner clears the folder
        pass


def _drop_at_exit(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session has ended before
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there is deleted when the process ends."""
    path = f"{shared_folder(spark)}/sorrel-{_run}/{next(_tables):05d}-{name}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and no step runs twice."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df written as a table in buckets of a key and read again: what is joined with it on that key moves alone."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"sorrel_{_run}_{path.rpartition('/')[2]}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    atexit.register(_drop_at_exit, spark, table)
    return spark.table(table)


def spread(df: DataFrame, rows: int, *keys: str, each: int = 20000) -> DataFrame:
    """df in as many partitions as its number of rows asks for, so that work that widens short rows has enough tasks."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *(F.col(k) for k in keys))


def frequent(*keys: str, share: int = 512) -> list[Column]:
    """Aggregates for `hot_values`: sketches of bounded size of the keys' most frequent values, and the number of rows."""
    return [*(F.expr(f"approx_top_k(xxhash64({k}), {share}, {16 * share})").alias(f"_top_{k}") for k in keys), F.count("*").alias("_rows")]


def hot_values(row: Row, *keys: str, share: int = 512) -> list[int]:
    """Hashes of the values that hold more than about 1 / share of the rows, at most `share` of each key."""
    return [x["item"] for k in keys for x in row[f"_top_{k}"] or [] if x["count"] * share > row["_rows"]]


def salted_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", hot: list[int] | None = None, salt: Column | None = None, salts: int = 32) -> DataFrame:
    """rows joined with unique, which has one row a key, without one task for all rows of a frequent key.

    The rows of hot keys (hashes from a sketch, made here if none are given) are dealt by salt over `salts` partitions,
    to each of which the key's one row goes. The sketch decides about speed alone: whatever it finds, each row meets its
    key's row once. Without a salt, rows must come from a scan, whose row numbers are the same when a task runs again.
    """
    if hot is None:
        hot = hot_values(rows.agg(*frequent(key)).first(), key)
    if not hot:
        return rows.join(unique, key, how)
    is_hot = F.xxhash64(key).isin(hot)
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id() if salt is None else salt, F.lit(salts))).otherwise(0).cast("int"))
    right = unique.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Bits of a `Bits` map at most: 16 MB.
MOST_BITS = 1 << 27


class Bits:
    """A map of bits, sent to all tasks, that tells which hashes aren't among known ones; it never says so of one that is.

    The map grows with the known hashes (a column of 64-bit hashes without bias) up to MOST_BITS, so what is sent is
    bounded; beyond that it lets more through, and none less. For rows that an exact join follows.
    """

    def __init__(self, known: DataFrame, key: str):
        values = known.select(F.col(key).alias("h")).distinct()
        self.size = min(MOST_BITS, 1 << max(15, (64 * values.count()).bit_length()))
        place = F.pmod("h", F.lit(self.size)) + 1
        self.parts = stored(values.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")), "bits")
        bits = np.zeros((self.size // 32768, 4096), np.uint8)
        for r in self.parts.collect():  # size / 8 bytes at most
            bits[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
        self.sent = known.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))
        self.held: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None, "parts": None}

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.held is None:
            self.held = np.frombuffer(zlib.decompress(self.sent.value), np.uint8)
        at = hashes.astype(np.int64, copy=False) & (self.size - 1)
        return (self.held[at >> 3] >> (at & 7)) & 1 == 1

    def marked(self, df: DataFrame, key: str, mark: str) -> DataFrame:
        """df with a column that says whether the hash in key may be among the known ones; for long rows, which stay in the JVM."""
        place, part = F.pmod(F.col(key), F.lit(self.size)), free_name(df, "part")
        table = F.broadcast(self.parts.select((F.col("b") - 1).alias(part), F.col("bits").alias(f"{part}_bits")))  # size / 8 bytes at most
        at = place % 32768
        byte = F.conv(F.hex(F.substring(F.col(f"{part}_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.coalesce(F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1, F.lit(False))
        return df.withColumn(part, F.floor(place / 32768)).join(table, part, "left").withColumn(mark, bit).drop(part, f"{part}_bits")

    def rows(self, df: DataFrame, key: str, held: bool = True) -> DataFrame:
        """The rows of df whose hash in a column may be among the known ones, or those whose hash isn't; null hashes are none."""
        own, place = self, df.columns.index(key)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(place)
                found = own(h.fill_null(0).to_numpy()) & ~h.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found if held else ~found))

        return df.mapInArrow(work, df.schema)


def by_batch(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, object]]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields columns; Spark bounds each batch by rows and by 64 MB."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def rows_kept(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of docs whose text (a null one as an empty one) keep says yes to, with all their columns; no shuffle.

    Each row is judged by its own text, so rows without an id or with the id of another are like any other.
    """
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            texts = batch.column(place).cast(pa.binary()).fill_null(b"").to_pylist()
            yield batch.filter(pa.array(np.asarray(keep(texts), bool)))

    return docs.mapInArrow(work, docs.schema)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A column of strings as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about size bytes of text, one row at least: bounds what Python holds at once."""
    start = 0
    ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("text"))).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return text.lower().split()


_word_hashes = Kept(lambda words: [xxhash.xxh64_intdigest(w, 7) for w in words])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(_word_hashes([words])[0], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """A hash for each run of width words, in order; the whole sequence if there are fewer; none without words."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(width, len(h))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)


def env_single_thread() -> None:
    """Spark runs the tasks side by side; libraries in them take one thread each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
