"""Similarity joins of sets: pairs with a Jaccard similarity of at least a bound, best match a key, one-to-one assignment.

Tokens of a group are put in order of rarity. Two sets that are similar enough share a token among the first few of each
(a prefix whose length follows from the bound), so prefixes alone are joined, and a pair goes on only if its sizes and
the places of the common token leave room for enough more; what is left is compared exactly. A token that many sets hold
is no key: two sets that both have such a token in their prefix are hot and meet in tiles instead. Hot sets are dealt
into blocks of like size, as tokens' numbers with the keys of their rows, and a pair of blocks whose sizes fit is one
tile (`settiles`), which gives pairs of keys with their exact similarity. A tile's memory is bounded; tiles' work, not
what is moved for it, grows with the square of hot sets: a set is moved once a tile that its block is in.

In a group of few rows that costs more than it saves: best matches and assignments compare all pairs of such groups, so
that a row meets FEW others at most, and only larger groups go through prefixes.

Equal sets of a larger group are compared once. Nothing is dropped: each of these steps keeps every pair at or above the bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.operators.relational import greedy_pairs
from sorrel.operators.settiles import key_pairs
from sorrel.session import kept

#: A token that more sets of a group hold is frequent.
FREQUENT = 128
#: Products of sizes with the bound are rounded here before the ceiling is taken, so 0.15 * 20 is 3.
_PLACES = 9
#: A group of so many rows, both sides together, is compared pair by pair.
FEW = 64
#: Sets of a block at most, and tokens and keys of them; up to so many different tokens a tile's sets are all held as bits.
BLOCK, CODES, TOKENS = 65536, 1 << 23, 4096
#: Up to so many different tokens, without groups, each task has them all.
VOCABULARY = 32767
#: Pairs of sets that a task compares at least.
EACH = 1 << 26
#: Rows with equal sets go into a tile together, in so many parts.
PARTS = 64


def _least(bound: float, n: Column) -> Column:
    """How many common tokens a set of n needs at least with any other one."""
    return F.greatest(F.lit(1), F.ceil(F.round(F.lit(bound) * n, _PLACES))).cast("int")


def _needed(bound: float, n: Column, m: Column) -> Column:
    """How many common tokens sets of n and m need."""
    return F.greatest(F.lit(1), F.ceil(F.round(F.lit(bound / (1 + bound)) * (n + m), _PLACES))).cast("int")


def _ordered(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, set (a hash of the sorted tokens), n, and ids and times of the tokens in order of rarity; one row a set."""
    each = sets.select(*by, F.sort_array(F.array_distinct("tokens")).alias("tokens")).where("size(tokens) > 0")
    each = each.withColumn("set", F.struct(F.xxhash64("tokens").alias("a"), F.xxhash64(F.reverse("tokens"), F.lit(1)).alias("b")))
    if by:
        each = kept(each.dropDuplicates([*by, "set"]), "sets")
    # Copies count here too, as the order's choice is free.
    times = each.select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("times"))
    times = kept(times.withColumn("id", F.monotonically_increasing_id()), "times")  # its file says that it is the smaller side
    if not by and times.count() <= VOCABULARY:
        return kept(_coded(each, times).dropDuplicates(["set"]), "ordered")
    single = each.dropDuplicates([*by, "set"]).select(*by, "set", F.explode("tokens").alias("token"))
    rows = single.join(times, [*by, "token"]).groupBy(*by, "set").agg(F.sort_array(F.collect_list(F.struct("times", "id"))).alias("t"))
    return kept(rows.select(*by, "set", F.size("t").alias("n"), F.col("t.id").alias("ids"), F.col("t.times").alias("times")), "ordered")


def _coded(sets: DataFrame, times: DataFrame) -> DataFrame:
    """set, n, ids, times as `_ordered` has them, of few different tokens: an id is a token's rank, and no token is moved."""
    ranked = times.orderBy("times", "token").select("token", "times").toArrow()
    tokens, numbers = ranked["token"].combine_chunks(), ranked["times"].to_numpy()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            n = pc.list_value_length(lists).to_numpy().astype(np.int32)
            ranks = pc.index_in(lists.flatten(), value_set=tokens).to_numpy()
            ranks = ranks[np.lexsort((ranks, np.repeat(np.arange(len(n)), n)))]
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["set"], pa.array(n), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ranks.astype(np.int16), numbers[ranks]))], ["set", "n", "ids", "times"])

    return sets.select("set", "tokens").mapInArrow(code, "set struct<a: long, b: long>, n int, ids array<short>, times array<long>")


def _prefix(bound: float) -> Column:
    """The number of rarest tokens of which similar sets share one at least."""
    return F.col("n") - _least(bound, F.col("n")) + 1


def _hot(bound: float, frequent: int) -> Column:
    """Whether a set's prefix has a frequent token; times rise."""
    return F.element_at("times", _prefix(bound)) > frequent


def _keys(ordered: DataFrame, by: Sequence[str], bound: float, frequent: int) -> DataFrame:
    """by, set, n, hot, key, place (of the key's token) for the tokens of prefixes that aren't frequent."""
    rare = F.size(F.filter(F.slice("times", F.lit(1), _prefix(bound)), lambda t: t <= frequent))
    return ordered.select(*by, "set", "n", _hot(bound, frequent).alias("hot"), F.posexplode(F.slice("ids", F.lit(1), rare)).alias("place", "key"))


def _tiles(a: DataFrame, b: DataFrame | None, by: Sequence[str], bound: float) -> DataFrame:
    """by, a, b, similarity of all keys of sets of a and b (by, set, n, ids, keys) that are similar enough, by blocks of sets of like size.

    Without b all pairs of rows of a, each once. Keys go with their sets, so no pair is moved or kept.
    """
    # Two bands of sizes from one set to the largest or smallest that may be similar to it.
    band = F.floor(F.log(F.col("n")) * (2 / max(-np.log(bound), 0.01))).cast("int")
    one = b is None
    a = a.withColumn("_band", band)
    b = a if one else b.withColumn("_band", band)
    counts = lambda x: x.groupBy(*by, "_band").agg(F.count("*").alias("_sets"), F.sum(F.col("n") + F.size("keys")).alias("_codes"), F.min("n").alias("_low"), F.max("n").alias("_high"))
    each = lambda x: min(BLOCK, max(2048, (x.agg(F.sum("_sets")).first()[0] or 0) // 16))  # noqa: E731  few sets are several tiles too
    of = lambda x: kept(x.withColumn("_of", F.ceil(F.greatest(F.col("_sets") / each(x), F.col("_codes") / CODES)).cast("int")), "bands")
    x = of(kept(counts(a), "counts"))
    y = x if one else of(kept(counts(b), "counts"))
    blocks = lambda z, c: z.select(*by, F.col("_band").alias(f"_band_{c}"), F.col("_low").alias(f"low_{c}"), F.col("_high").alias(f"high_{c}"), (F.col("_sets") / F.col("_of")).alias(f"sets_{c}"), F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias(f"_block_{c}"))
    fits = (F.col("high_b") >= F.col("low_a") * bound - 1e-6) & (F.col("high_a") >= F.col("low_b") * bound - 1e-6)
    places = F.struct("_band_a", "_block_a"), F.struct("_band_b", "_block_b")
    left, right = blocks(x, "a"), blocks(y, "b")
    met = (left.join(right, list(by)) if by else left.crossJoin(right)).where(fits & (places[0] <= places[1] if one else F.lit(True)))
    tiles = kept(met.select(*by, *(f"_{k}_{c}" for c in "ab" for k in ("band", "block")), (F.col("sets_a") * F.col("sets_b")).alias("_cells")).withColumn("_tile", F.monotonically_increasing_id()), "tiles")
    types = {"a": a.schema["keys"].dataType, "b": b.schema["keys"].dataType}

    def rows(sets: DataFrame, of: DataFrame, tiles: DataFrame, c: str, side: int) -> DataFrame:
        dealt = sets.join(of.select(*by, "_band", "_of"), [*by, "_band"]).withColumn("_block", F.pmod(F.xxhash64("set", "_part"), F.col("_of")).cast("int"))
        met = dealt.hint("merge").join(tiles.select(*by, F.col(f"_band_{c}").alias("_band"), F.col(f"_block_{c}").alias("_block"), "_tile"), [*by, "_band", "_block"])
        own = ((F.col("keys") if one or k == c else F.lit(None).cast(types[k])).alias(f"keys_{k}") for k in ("a" if one else "ab"))
        return met.select(*by, "_tile", F.lit(side).alias("side"), "n", "ids", *own)

    schema = ", ".join([*(f"{k} {dict(a.dtypes)[k]}" for k in by), *(f"{c} {t.elementType['k'].dataType.simpleString()}" for c, t in types.items()), "similarity double"])
    tokens = TOKENS

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        for p, q, similarity in key_pairs(table, bound, tokens, one):
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(p)) for k in key[: len(by)]), p, q, pa.array(similarity)], [*by, "a", "b", "similarity"])

    both = rows(a, x, tiles, "a", 0).unionByName(rows(b, y, tiles.where(places[0] != places[1]) if one else tiles, "b", 1))
    least = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, cells = tiles.agg(F.count("*"), F.sum("_cells")).first()
    dealt = both.repartition(max(least, min(n, int(cells or 0) // EACH)), *by, "_tile")  # much work on few bytes
    return dealt.groupBy(*by, "_tile").applyInArrow(pairs, schema)


def _rare_pairs(left: DataFrame, right: DataFrame, ordered: DataFrame, by: Sequence[str], bound: float, frequent: int, once: bool = False) -> DataFrame:
    """by, _set_a, _set_b, similarity of the sets of left and right that are similar enough and not both hot."""
    # Joins of exploded or compressed sides are merges: a plan takes them for as small as their files.
    keys = _keys(ordered, by, bound, frequent)
    of = lambda x: x.select(*by, "set").distinct()
    side = lambda x, name: keys.join(of(x), [*by, "set"], "left_semi").select(*by, F.col("set").alias(f"_set_{name}"), F.col("n").alias(f"n_{name}"), F.col("hot").alias(f"hot_{name}"), "key", F.col("place").alias(f"p_{name}"))
    met = side(left, "a").hint("merge").join(side(right, "b"), [*by, "key"]).where(~(F.col("hot_a") & F.col("hot_b")))
    if once:
        met = met.where("_set_a <= _set_b")
    needed = _needed(bound, F.col("n_a"), F.col("n_b"))
    # The first common token leaves no more than what follows it in either set.
    room = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    large = F.least("n_a", "n_b") >= _least(bound, F.greatest("n_a", "n_b"))
    found = met.where(large & (room >= needed)).select(*by, "_set_a", "_set_b").distinct()
    ids = ordered.select(*by, "set", "ids").hint("merge")
    both = found.join(ids.select(*by, F.col("set").alias("_set_a"), F.col("ids").alias("x")), [*by, "_set_a"]).join(ids.select(*by, F.col("set").alias("_set_b"), F.col("ids").alias("y")), [*by, "_set_b"])
    common = F.size(F.array_intersect("x", "y"))
    return both.select(*by, "_set_a", "_set_b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= bound)


def _entries(rows: DataFrame, ordered: DataFrame, by: Sequence[str], key: str, bound: float, frequent: int) -> DataFrame:
    """by, set, _part, n, ids, keys: hot sets with the keys of their rows; many rows of a set are several entries."""
    hot = ordered.where(_hot(bound, frequent)).select(*by, "set", "n", "ids")
    own = rows.groupBy(*by, "set", F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("_part")).agg(F.collect_list(F.struct(F.col(key).alias("k"))).alias("keys"))
    return kept(own.join(hot, [*by, "set"]), "entries")


def _has_hot(ordered: DataFrame, bound: float, frequent: int) -> bool:
    return not ordered.where(_hot(bound, frequent)).isEmpty()


def _set_pairs(left: DataFrame, right: DataFrame, ordered: DataFrame, by: Sequence[str], bound: float, frequent: int) -> DataFrame:
    """by, _set_a, _set_b, similarity of the sets of left and right (columns by, set) that are similar enough; a set with itself too."""
    found = _rare_pairs(left, right, ordered, by, bound, frequent)
    if not _has_hot(ordered, bound, frequent):
        return found
    a, b = (_entries(x.select(*by, "set", F.col("set").alias("_own")).distinct(), ordered, by, "_own", bound, frequent) for x in (left, right))
    return found.unionByName(_tiles(a, b, by, bound).withColumnsRenamed({"a": "_set_a", "b": "_set_b"}))


def _with_set(df: DataFrame, by: Sequence[str], key: str, tokens: str) -> DataFrame:
    t = F.sort_array(F.array_distinct(F.col(tokens)))
    return df.select(*by, key, F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.reverse(t), F.lit(1)).alias("b")).alias("set"), t.alias("tokens")).where("size(tokens) > 0")


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, bound: float, by: Sequence[str] = (), frequent: int = FREQUENT) -> DataFrame:
    """by, left_key, right_key, similarity of all pairs of rows of a group whose token arrays have at least this Jaccard similarity.

    Null and empty arrays are similar to none; null groups are none; rows that repeat make pairs of their own; the two
    keys have different names. bound is above 0. Rows with equal sets are all paired at the end, as the result asks.
    """
    left, right = kept(_with_set(left, by, left_key, tokens), "left"), kept(_with_set(right, by, right_key, tokens), "right")
    ordered = _ordered(left.select(*by, "tokens").unionByName(right.select(*by, "tokens")), by)
    x, y = left.select(*by, left_key, F.col("set").alias("_set_a")), right.select(*by, right_key, F.col("set").alias("_set_b"))
    found = _rare_pairs(left, right, ordered, by, bound, frequent).join(x, [*by, "_set_a"]).join(y, [*by, "_set_b"]).select(*by, left_key, right_key, "similarity")
    if not _has_hot(ordered, bound, frequent):
        return found
    a, b = _entries(left, ordered, by, left_key, bound, frequent), _entries(right, ordered, by, right_key, bound, frequent)
    return found.unionByName(_tiles(a, b, by, bound).withColumnsRenamed({"a": left_key, "b": right_key}))


def pairs_within(rows: DataFrame, key: str, tokens: str, bound: float, by: Sequence[str] = (), frequent: int = FREQUENT) -> DataFrame:
    """by, a, b, similarity of each two rows of a group whose token arrays have at least this Jaccard similarity, the smaller key as a.

    As `similar_pairs` of rows with themselves, but each pair is compared once; rows with equal keys are no pair.
    """
    rows = kept(_with_set(rows, by, key, tokens).withColumnRenamed(key, "_key"), "rows")
    ordered = _ordered(rows.select(*by, "tokens"), by)
    x, y = (rows.select(*by, F.col("_key").alias(c), F.col("set").alias(f"_set_{c}")) for c in "ab")
    found = _rare_pairs(rows, rows, ordered, by, bound, frequent, once=True).join(x, [*by, "_set_a"]).join(y, [*by, "_set_b"])
    found = found.where("_set_a <> _set_b OR a < b").select(*by, "a", "b", "similarity")
    if _has_hot(ordered, bound, frequent):
        found = found.unionByName(_tiles(_entries(rows, ordered, by, "_key", bound, frequent), None, by, bound))
    return found.where("a <> b").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def _by_size(left: DataFrame, right: DataFrame, by: Sequence[str], few: int) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """left and right of the groups of at most few rows, and of the larger ones if there are any; without columns by, all is one group."""
    grouped = reduce(Column.__and__, (F.col(k).isNotNull() for k in by), F.lit(True))
    left, right = left.where(grouped), right.where(grouped)  # null groups are none
    large = kept(left.select(*by).unionByName(right.select(*by)).groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > few).drop("_rows"), "large") if by else None
    if large is not None and large.isEmpty():
        return (left, right), None
    if large is None:
        return (left.limit(0), right.limit(0)), (left, right)
    of = lambda how: tuple(x.join(large, list(by), how) for x in (left, right))
    return of("left_anti"), tuple(kept(x, "large-rows") for x in of("left_semi"))


def _all_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], bound: float) -> DataFrame:
    """left's columns but tokens, right's as well, with similarity, of the pairs of a group's rows that are similar enough."""
    met = left.withColumnsRenamed({"set": "_set_a", "tokens": "x"}).hint("merge").join(right.withColumnsRenamed({"set": "_set_b", "tokens": "y"}), list(by))
    n, m = F.size("x"), F.size("y")
    met = met.where(F.least(n, m) >= _least(bound, F.greatest(n, m))).withColumn("_common", F.size(F.array_intersect("x", "y")))
    return met.withColumn("similarity", F.col("_common") / (n + m - F.col("_common"))).drop("x", "y", "_common").where(F.col("similarity") >= bound)


def _bounds(least: float) -> list[float]:
    return [b for b in (0.5,) if b > least] + [least]


def best_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, least: float, by: Sequence[str] = (), frequent: int = FREQUENT) -> DataFrame:
    """by, left_key, right_key, similarity: the most similar row of right for each row of left, ties to the smallest key.

    Bounds fall step by step: what has a match above a bound has its best one there, so only the others go on to the next
    and longer prefixes. Rows without a match of at least `least` aren't in the result.
    """
    left, right = kept(_with_set(left, by, left_key, tokens), "left"), kept(_with_set(right, by, right_key, tokens), "right")
    # The least struct has the largest similarity; of equal ones the smallest key comes first in ascending order.
    best_of = lambda met: met.groupBy(*by, F.col("_set_a").alias("set")).agg(F.min(F.struct((-F.col("similarity")).alias("away"), F.col(right_key))).alias("m"))
    small, large = _by_size(left, right, by, FEW)
    done = [best_of(_all_pairs(small[0].drop(left_key), small[1], by, least))] if by else []
    if large:
        some, others = large
        ordered = _ordered(some.select(*by, "tokens").unionByName(others.select(*by, "tokens")), by)
        first = others.groupBy(*by, F.col("set").alias("_set_b")).agg(F.min(right_key).alias(right_key))
        rest = some.select(*by, "set").distinct()
        for bound in _bounds(least):
            best = kept(best_of(_set_pairs(rest, others, ordered, by, bound, frequent).join(first, [*by, "_set_b"])), "best")
            done.append(best)
            rest = kept(rest.join(best.select(*by, "set"), [*by, "set"], "left_anti"), "rest")
    found = reduce(DataFrame.unionByName, done)
    return left.select(*by, left_key, "set").join(found, [*by, "set"]).select(*by, left_key, F.col(f"m.{right_key}").alias(right_key), (-F.col("m.away")).alias("similarity"))


def assigned(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, least: float, by: str, frequent: int = FREQUENT) -> DataFrame:
    """by, left_key, right_key, similarity: one-to-one pairs of a group, the most similar first, ties by left and right key.

    Whole numbers as keys, unique in a group. Pairs above a bound are all taken before any below it, so bounds fall here
    too, and rows that have a partner go no further.
    """
    left, right = kept(_with_set(left, [by], left_key, tokens), "left"), kept(_with_set(right, [by], right_key, tokens), "right")
    small, large = _by_size(left, right, [by], FEW)
    pairs = _all_pairs(*small, [by], least)
    done = [kept(greedy_pairs(pairs, by, left_key, right_key, "similarity", least), "assigned")]
    if large:
        ordered = _ordered(large[0].select(by, "tokens").unionByName(large[1].select(by, "tokens")), [by])
        rest_l, rest_r = large[0].drop("tokens"), large[1].drop("tokens")
        for bound in _bounds(least):
            pairs = _set_pairs(rest_l, rest_r, ordered, [by], bound, frequent)
            pairs = pairs.join(rest_l.withColumnRenamed("set", "_set_a"), [by, "_set_a"]).join(rest_r.withColumnRenamed("set", "_set_b"), [by, "_set_b"])
            taken = kept(greedy_pairs(pairs, by, left_key, right_key, "similarity", bound), "assigned")
            done.append(taken)
            rest_l = rest_l.join(taken.select(by, left_key), [by, left_key], "left_anti")
            rest_r = rest_r.join(taken.select(by, right_key), [by, right_key], "left_anti")
    return reduce(DataFrame.unionByName, done)
