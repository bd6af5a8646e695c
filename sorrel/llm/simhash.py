"""SimHash near-duplicates by covering anchors.

Fingerprints that differ in at most `threshold` bits are linked; components are the documents that links connect.

The 64 bits are cut into blocks. Two fingerprints within 4 bits differ in one of three blocks by 1 bit at most, in one
of two by 2. Each block is covered by anchors: its first bits by a perfect Hamming code, whose covering radius is 1, its
other bits by themselves. In every block a fingerprint has one home anchor within the radius, and is replicated to all
anchors within radius plus the block's share of the threshold; so of any linked pair, one stands at the other's home.
Fingerprints are compared at each anchor, homes against replicas. Three blocks with a code of 15 bits give 400,000
anchors and 45 replicas; from 2 ** 28 distinct fingerprints on two blocks with a code of 31 bits give 268 million
anchors, so that the comparisons at an anchor don't grow with the corpus.

Equal fingerprints are collapsed first, so a group of copies is one fingerprint however large it is. An anchor that is
home to more than CROWD fingerprints is cut into chunks, each two of which meet in a cell of their own. A cell returns a
forest of its links, one edge for each fingerprint at most, never all its pairs. What a task holds is the distinct
fingerprints of one cell, 8 bytes each. Components are found by rounds of minimum labels over the edges, each round a
written table; rows of a fingerprint or node that holds many of them are salted where they are joined. Nothing but
counts and hashes of at most a few hundred hot keys reaches the driver.

Null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than a shingle is one
shingle; a very long text is hashed whole, 8 bytes a word; repeated rows are kept, each with its component; a null id has no say in
the component's id, which is null where all ids are. No documents give no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, frequent, hot_values, pieces, raw, salted_join, spread, stored, words_of

WIDTH, THRESHOLD, SEED = 4, 4, 42
_SIGN = np.uint64(1 << 63)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the 64-bit hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes of the runs of width words, repeats counted."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest, seed = xxhash.xxh64_intdigest, SEED
    n = len(words) - width + 1
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer, of every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            fp = np.array([fingerprint(t, width) for t in raw(batch, "text")], np.uint64)
            yield {"doc_id": batch.column(0), "fp": fp.view(np.int64)}

    return by_batch(documents(docs), work, "doc_id long, fp long")


@dataclass(frozen=True)
class Layout:
    """Lowest bit and width of each block, and how many of its bits the Hamming code covers."""

    blocks: tuple[tuple[int, int], ...]
    coded: int


THREE, TWO = Layout(((0, 21), (21, 21), (42, 22)), 15), Layout(((0, 32), (32, 32)), 31)
#: Distinct fingerprints from which on two blocks are used; homes at an anchor from which on it is cut.
MANY, CROWD = 1 << 28, 4096


def _syndromes(x: np.ndarray, coded: int) -> np.ndarray:
    """Exclusive or of the positions (from 1) of the bits that are set: 0 for words of the Hamming code."""
    out = np.zeros(len(x), np.int64)
    for k in range(coded):
        out ^= (k + 1) * ((x >> k) & 1)
    return out


def _flips(bits: int, most: int) -> list[list[int]]:
    """By number of flipped bits up to most: all patterns over so many bits."""
    out: list[list[int]] = [[0]]
    for _ in range(most):
        out.append(sorted({p | 1 << k for p in out[-1] for k in range(bits) if not p >> k & 1}))
    return out


@lru_cache
def _patterns(coded: int, plain: int, share: int) -> list[list[tuple[np.ndarray, bool]]]:
    """For each syndrome the changes of a block that lead to its anchors, in groups: within the radius or not."""
    by_weight = [np.array(p, np.int64) for p in _flips(coded, 1 + share)]
    rest = [np.array(p, np.int64) << coded for p in _flips(plain, min(plain, 1 + share))]
    found: list[list[tuple[np.ndarray, bool]]] = [[] for _ in range(coded + 1)]
    for d, patterns in enumerate(by_weight):
        syndromes = _syndromes(patterns, coded)
        for s in np.unique(syndromes).tolist():
            for r in range(min(len(rest), 2 + share - d)):
                found[s].append(((patterns[syndromes == s][:, None] | rest[r][None, :]).ravel(), d <= 1 and r == 0))
    return found


def anchors(fp: np.ndarray, threshold: int = THRESHOLD, layout: Layout = THREE, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index into fp, anchor and home flag for all anchors within the covering radius plus the share of the threshold."""
    share, coded = threshold // len(layout.blocks), layout.coded
    indices, keys, homes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for number, (low, width) in enumerate(layout.blocks):
        x = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = _syndromes(x, coded)
        for s, groups in enumerate(_patterns(coded, width - coded, share)):
            own = np.flatnonzero(syndrome == s)
            for e, home in groups if len(own) else []:
                if home or not homes_only:
                    keys.append(((x[own][:, None] ^ e[None, :]) | number << 32).ravel())
                    indices.append(np.repeat(own, len(e)))
                    homes.append(np.full(len(own) * len(e), home))
    return np.concatenate(indices), np.concatenate(keys), np.concatenate(homes)


def connected(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the index of a member) after the links a - b: the smallest label that a row is connected with."""
    while True:
        low = np.minimum(label[a], label[b])
        to = np.arange(len(label))
        np.minimum.at(to, label[a], low)
        np.minimum.at(to, label[b], low)
        new = to[label]
        if (new == label).all():
            return label
        label = new


def forest(fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """For each fingerprint of one anchor the index of the smallest one that links home x replica connect it with."""
    label = np.arange(len(fp))
    rows = np.flatnonzero(home)
    step = max(16, (1 << 22) // max(1, len(fp)))
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        a, b = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[None, :]) <= threshold)
        label = connected(label, part[a], b)
    return label


def edges(distinct: DataFrame, threshold: int = THRESHOLD, layout: Layout | None = None, crowd: int = CROWD) -> DataFrame:
    """Pairs (u, v) of linked fingerprints, u > v, that connect what links connect."""
    n = distinct.count()
    layout = layout or (THREE if n < MANY else TWO)
    if threshold // len(layout.blocks) > 2:
        raise ValueError("blocks are covered for 2 differing bits each at most")
    wide = spread(distinct.select("fp"), n)

    def replicate(batches: Iterator[pa.RecordBatch], homes_only: bool = False) -> Iterator[dict]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 4096):
                own = fp[k : k + 4096]
                at, key, home = anchors(own, threshold, layout, homes_only)
                yield {"anchor": key, "fp": own.view(np.int64)[at], "home": home}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, fp, home = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            home = np.concatenate([home, batch.column(2).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
            yield compared(key[:whole], fp[:whole], home[:whole])
            key, fp, home = key[whole:], fp[whole:], home[whole:]
        yield compared(key, fp, home)

    def compared(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> dict:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        large = np.repeat(sizes > 256, sizes)
        label = np.arange(len(key))
        links = [np.zeros((2, 0), np.int64)]
        for k in range(1, min(int(sizes.max(initial=1)), 256)):  # small anchors: all at once, each row with the k-th after it
            same = (key[k:] == key[:-k]) & ~large[k:]
            if not same.any():
                break
            i = np.flatnonzero(same & (home[k:] | home[:-k]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= threshold]
            links.append(np.stack([i, i + k]))
        label = connected(label, *np.concatenate(links, axis=1))
        for start, size in zip(starts[sizes > 256], sizes[sizes > 256], strict=True):
            label[start : start + size] = start + forest(fp[start : start + size], home[start : start + size], threshold)
        moved = np.flatnonzero(label != np.arange(len(key)))
        u, v = fp[moved], fp[label[moved]]
        return {"u": np.maximum(u, v).view(np.int64), "v": np.minimum(u, v).view(np.int64)}

    schema = "anchor long, fp long, home boolean"
    crowded = by_batch(wide, lambda b: replicate(b, True), schema).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    crowded = stored(crowded.select("anchor", F.least(F.ceil(F.col("n") / crowd), F.lit(4096)).cast("int").alias("chunks")), "crowded")
    rows = by_batch(wide, replicate, schema).withColumn("cell", F.col("anchor") * (1 << 24))
    if not crowded.isEmpty():
        rows = rows.join(crowded, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        as_home = F.when(F.col("home"), F.transform(every, lambda b: F.struct((own * 4096 + b).alias("pair"), F.lit(True).alias("home")))).otherwise(F.array().cast("array<struct<pair: int, home: boolean>>"))
        others = F.filter(every, lambda a: ~F.col("home") | (a != own))
        as_member = F.transform(others, lambda a: F.struct((a * 4096 + own).alias("pair"), F.lit(False).alias("home")))
        cells = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("pair"), F.col("home").alias("home")))).otherwise(F.concat(as_home, as_member))
        rows = rows.select("cell", "fp", F.explode(cells).alias("c")).select((F.col("cell") + F.col("c.pair")).alias("cell"), "fp", "c.home")
    dealt = rows.select("cell", "fp", "home").repartition("cell").sortWithinPartitions("cell", "fp")
    return by_batch(dealt, compare, "u long, v long").distinct()


def components(pairs: DataFrame, rounds: int = 64) -> DataFrame:
    """(fp, root): each end of pairs (u > v as unsigned) with the smallest id that it is connected with.

    Rounds of large stars and small stars: each node hands its neighbours the smallest one it knows. A node's minimum is
    aggregated before it is joined back, so a node with most of the edges isn't gathered in one place.
    """

    def star(e: DataFrame, hot: list[int] | None) -> DataFrame:
        """A large star; without a list of hot nodes a small one, whose nodes have few neighbours left."""
        both = e if hot is None else e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if hot is not None:
            out = salted_join(both, low, "u", hot=hot, salt=F.xxhash64("v"))
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        out = both.join(low, "u")
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m"))).where("u <> v").distinct()

    flipped = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))).alias(c) for c in ("u", "v")]  # order as unsigned
    e = stored(pairs.select(*flipped), "edges")
    state = (F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"), *frequent("u", "v"))
    now = e.agg(*state).first()
    for _ in range(rounds):
        e = stored(star(star(e, hot_values(now, "u", "v")), None), "edges")
        before, now = now, e.agg(*state).first()
        if (now["_rows"], now["sum"]) == (before["_rows"], before["sum"]):
            break
    else:
        raise RuntimeError("components did not settle")
    back = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))).alias(n) for c, n in (("u", "fp"), ("v", "root"))]
    return e.select(*back)


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component), n_fingerprints of every row."""
    rows = stored(fingerprints(docs, width), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    distinct = stored(distinct, "distinct")
    roots = components(edges(distinct, threshold))
    named = stored(distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_fingerprints"))
    by_fp = salted_join(named, lows, "root").select("fp", "component_id", "n_fingerprints")
    return salted_join(rows, by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_fingerprints")
