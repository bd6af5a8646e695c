"""Source divergence audit: how far the sources of each language are apart in the terms that they use.

Terms are counted by (lang, source) in each task first, then by key; a language keeps the terms that enough of its
documents hold. Kept terms are dealt by a hash into vocabulary chunks of about CHUNK terms, and each group's counts in a
chunk are packed into one row of positions and counts. The groups of a language are cut into blocks of BLOCK. A packed
row goes to each of the block-by-block tiles that its group is in, and a tile adds up the differences of all its pairs
over one vocabulary chunk after another: it holds two blocks' rows of one chunk and a matrix of block by block sums,
whatever the vocabulary and the number of groups. Each pair of groups is in one tile.

All shares are exact: p = 1 + floor(UNIT * (count + ADDED) / (total + ADDED * V)) in 64-bit integers by three steps of
long division, so totals up to 9 * 10^15 are right.

Null texts, languages and sources are read as empty; a text without terms still makes its group; very long texts are
counted in slices; repeated rows count each time; terms and sources that tie are in the order of their UTF-8 bytes; a
language without kept terms has pairs of value 0 and no terms; no documents give no rows. Other columns are ignored,
whatever their names. A source with a third of all rows is many tasks' sums for each term, never one task's texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, pieces, salted_join, stored

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
UNIT, THIRD, ADDED = 10**9, 10**3, 5  # UNIT is THIRD cubed
CHUNK, BLOCK = 2048, 8
SLICE = 1 << 22


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of those of about SLICE bytes; a term is never cut."""
    text, at = text.lower(), 0
    while at < len(text):
        gap = _GAP.search(text, min(at + SLICE, len(text)))
        end = gap.end() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and held (documents that hold it); each group has a row with a null term."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b, SLICE)):
            n: dict[tuple, Counter] = {}
            held: dict[tuple, Counter] = {}
            for lang, source, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(3)), strict=True):
                own, times = held.setdefault((lang, source), Counter()), n.setdefault((lang, source), Counter())
                once: set[bytes] = set()
                for terms in slices(text):
                    times.update(terms)
                    once.update(terms)
                own.update(once)
            for (lang, source), times in n.items():
                terms = [None, *times]
                own = held[lang, source]
                yield {"lang": [lang] * len(terms), "source": [source] * len(terms), "term": pa.array(terms, pa.binary()), "n": [0, *times.values()], "held": [0, *(own[t] for t in times)]}

    rows = by_batch(read, work, "lang binary, source binary, term binary, n long, held long")
    rows = rows.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "held")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / whole), exact."""
    out, rest = np.divmod(np.asarray(count, np.int64) + ADDED, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * THIRD, whole)
        out = out * THIRD + digit
    return out + 1


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """lang, term, chunk, position and the language's count of the terms that at least `least` documents of it hold."""
    terms = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("held").alias("held")).where(F.col("held") >= least).drop("held")
    sizes = terms.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    terms = salted_join(terms, sizes, "lang", salt=F.xxhash64("term")).withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("size") / CHUNK)).cast("int"))
    return terms.withColumn("position", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)


def pair_sums(tiles: DataFrame) -> DataFrame:
    """lang, a, b (slots of groups) and value, the sum of differences of shares, for each two groups of each tile.

    tiles has lang, left and right (blocks), chunk, slot, size (terms of the chunk), whole (denominator of the group),
    positions and counts; rows of a tile are together and in order of chunks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tile, chunk, rows = None, None, []
        sums: dict[tuple, int] = {}

        def add() -> None:
            """One chunk's rows into the sums of the tile."""
            _, left, right = tile
            slots = [r[0] for r in rows]
            p = np.empty((len(rows), rows[0][1]), np.int64)
            for i, (_, _, whole, positions, counts) in enumerate(rows):
                p[i] = share(np.zeros(1, np.int64), whole)
                if positions is not None and len(positions):
                    p[i, positions] = share(np.array(counts, np.int64), whole)
            first = [i for i, s in enumerate(slots) if s // BLOCK == left]
            second = [i for i, s in enumerate(slots) if s // BLOCK == right]
            for i in first:
                value = np.abs(p[second] - p[i]).sum(1)
                for j, v in zip(second, value.tolist(), strict=True):
                    if slots[i] < slots[j] or left != right:
                        key = (slots[i], slots[j])
                        sums[key] = sums.get(key, 0) + v

        def settled() -> dict:
            return {"lang": [tile[0]] * len(sums), "a": [a for a, _ in sums], "b": [b for _, b in sums], "value": list(sums.values())}

        for batch in batches:
            for lang, left, right, at, slot, size, whole, positions, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ((lang, left, right), at) != (tile, chunk) and rows:
                    add()
                    rows = []
                if (lang, left, right) != tile and sums:
                    yield settled()
                    sums.clear()
                tile, chunk = (lang, left, right), at
                rows.append((slot, size, whole, positions, counts))
        if rows:
            add()
        if sums:
            yield settled()

    columns = ("lang", "left", "right", "chunk", "slot", "size", "whole", "positions", "counts")
    dealt = tiles.select(*columns).repartition("lang", "left", "right").sortWithinPartitions("lang", "left", "right", "chunk", "slot")
    return by_batch(dealt, work, "lang string, a long, b long, value long")


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources of its language and its foremost terms.

    Part `pair` ranks the other sources by the sum of differences of shares over the language's kept terms, part `term`
    the group's terms by how far their share is above the language's, `top` of them.
    """
    counts = stored(term_counts(docs), "term-counts")
    terms = stored(kept_terms(counts, least), "kept-terms")
    present = counts.where("term is not null").join(terms.select("lang", "term", "chunk", "position", "lang_n", "lang_total", "size"), ["lang", "term"])
    present = stored(present.select("lang", "source", "term", "n", "chunk", "position", "lang_n", "lang_total", "size"), "present")
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    # A group's slot is its place in the order of its language's sources: rows here are groups, not documents.
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    slot = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("total", F.lit(0)) + ADDED * F.coalesce("v", F.lit(0))).alias("whole"))
    groups = stored(groups.withColumn("slot", slot).withColumn("groups", F.count("*").over(Window.partitionBy("lang"))), "groups")
    packed = present.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("position", "n")).alias("x"))
    packed = packed.select("lang", "source", "chunk", F.col("x.position").alias("positions"), F.col("x.n").alias("counts"))
    chunk_sizes = terms.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"))
    grid = groups.where("v > 0 and groups > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("v") / CHUNK).cast("int") - 1)))
    grid = grid.join(chunk_sizes, ["lang", "chunk"]).join(packed, ["lang", "source", "chunk"], "left")
    block, blocks = F.floor(F.col("slot") / BLOCK), F.ceil(F.col("groups") / BLOCK)
    tiles = grid.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select("*", F.least(block, F.col("other")).alias("left"), F.greatest(block, F.col("other")).alias("right"))
    found = pair_sums(tiles)
    both = found.select("lang", F.explode(F.array(F.struct(F.col("a").alias("slot"), F.col("b").alias("other")), F.struct(F.col("b").alias("slot"), F.col("a").alias("other")))).alias("x"), "value").select("lang", "x.*", "value")
    # Languages without kept terms have no chunks: their pairs are all 0.
    none = groups.where("v = 0 and groups > 1").select("lang", "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("other"), F.lit(0).cast("long").alias("value")).where("slot <> other")
    names = groups.select("lang", "slot", "source")
    pairs = both.unionByName(none).join(names, ["lang", "slot"]).join(names.select("lang", F.col("slot").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n, whole, lang_n, lang_whole = (batch.column(i).to_numpy() for i in range(3, 7))
            value = share(n, whole) - share(lang_n, lang_whole)
            keep = np.flatnonzero(value > 0)
            yield {c: batch.column(i).take(pa.array(keep)) for i, c in enumerate(("lang", "source", "item"))} | {"value": value[keep]}

    shares = present.where("n > 0").join(groups.select("lang", "source", "whole"), ["lang", "source"])
    shares = by_batch(shares.select("lang", "source", "term", "n", "whole", "lang_n", (F.col("lang_total") + ADDED * F.col("size")).alias("lang_whole")), above, "lang string, source string, item string, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    first = shares.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    first = first.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return first.unionByName(pairs.withColumn("rank", F.row_number().over(order)))
