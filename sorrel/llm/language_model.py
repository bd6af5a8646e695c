"""LM scoring with an n-gram trie in Elias-Fano coding, by interpolated absolute discounting.

Texts are read once and kept as blocks of about a million tokens: local word numbers, the block's distinct words, its
documents. What depends on the whole corpus is settled by exchanges between blocks and shards, of compact sorted arrays:

1. words: each block sends its distinct words and their training counts to shards by hash; a shard adds them up, numbers
   its words by falling frequency, and answers every block's words with counts and numbers. Every training word has a
   number of its own.
2. n-grams, a level after the other: each block sends its distinct n-grams and training counts to shards, bigrams by the
   hash of their context, longer ones to the shard that numbered the n-gram before their last word; a shard builds its
   trie level, writes it to a file that it maps into memory, and answers every block's n-grams by successor search. An
   n-gram's number is its place in its level, and stands for it as a context of the level above.

At last a block and its answers meet and its documents are scored: P(w | u v) = share(u v w) + rest(u v) P(w | v), down
to the unigram (c + 0.5) / (N + 0.5 (V + 1)). Shares are quantised downwards and the rest takes what they leave, so each
distribution sums to one. Words that training doesn't hold have no n-grams and the unigram of a count of 0.

The number of shards follows the number of tokens, so what a shard holds doesn't grow with the corpus; empty parts
aren't sent, so what is sent is never more than the blocks' distinct n-grams. A frequent word or n-gram costs one entry
a block, however often it occurs. A context that training holds more than `hot` times is cut by the words after it into
parts on shards of their own; its count as an n-gram of the level below is its total, which its parts can't add up, and
the shares that its parts have given away are summed where a block is scored. Blocks lie in buckets, so answers alone
move when they meet. The driver gets five sums. The trie's file
is a temporary one inside one task, which makes it anew when it runs again.

Null and empty texts are the end token alone; a very long text is a block of its own length; rows with a null id are
learnt from unless held out; repeated rows count each; words of equal count are numbered in byte order. Without training
rows every score is that of one empty count, 0; no documents give no rows. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.llm.common import bucketed, by_batch, mixed, pieces, stored
from sorrel.llm.elias_fano import SHARES, WORD, TrieLevel, memory_mapped, to_bytes

#: Tokens of a block and of a shard; occurrences from which on a context is cut; words in an n-gram.
BLOCK, SHARD, HOT, ORDER = 1 << 20, 1 << 21, 1 << 20, 3
UNKNOWN, BEGIN, FIRST = 0, 1, 2  # numbers below the words'


def packed(a: np.ndarray) -> bytes:
    """Unsigned integers or 32-bit floats by byte planes of the least width, compressed."""
    import zstandard

    a = a.view(np.uint32) if a.dtype == np.float32 else a
    a = np.ascontiguousarray(a.astype(np.min_scalar_type(int(a.max(initial=0)))))
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return a.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, wide: bool = True) -> np.ndarray:
    """As 64-bit unsigned integers, or as they were packed."""
    import zstandard

    dtype = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(dtype.itemsize, -1)
    out = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return out.astype(np.uint64) if wide else out


def unpacked_floats(data: bytes) -> np.ndarray:
    return unpacked(data).astype(np.uint32).view(np.float32).astype(float)


def packed_words(words: pa.Array) -> bytes:
    import zstandard

    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")[0].as_py()
    return zstandard.ZstdCompressor(level=1).compress(b"%d\n" % len(words) + joined)


def unpacked_words(data: bytes) -> pa.Array:
    """The words of packed_words as an Arrow array of bytes."""
    import zstandard

    n, _, rest = zstandard.ZstdDecompressor().decompress(data).partition(b"\n")
    ends = np.flatnonzero(np.frombuffer(rest + b"\n" if int(n) else b"", np.uint8) == 10)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), int(n), [None, pa.py_buffer(offsets), pa.py_buffer(rest.replace(b"\n", b""))])


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row after the other, so that no more of a batch than a block becomes Python objects at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]
        pa.default_memory_pool().release_unused()


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_starts(x)]


def distinct_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """high and low of the distinct pairs in ascending order, and each pair's place among them.

    Pairs and their places are sorted as one number each where 64 bits hold them.
    """
    n = len(high)
    own, at = (np.uint64(int(x).bit_length()) for x in (low.max(initial=0), max(0, n - 1)))
    kind = np.uint32 if n < 1 << 32 else np.int64
    keys = high.astype(np.uint64)
    keys <<= own
    keys |= low
    if int(high.max(initial=0)).bit_length() + int(own) + int(at) <= 64:
        keys <<= at
        keys |= np.arange(n, dtype=np.uint32 if n < 1 << 32 else np.uint64)
        keys.sort()
        order = (keys & ((np.uint64(1) << at) - np.uint64(1))).astype(kind)
        keys >>= at
    else:
        order = np.argsort(keys)
        keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if n else np.zeros(0, bool)
    inverse = np.empty(n, kind)
    inverse[order] = np.cumsum(first, dtype=kind) - kind(1)
    keys = keys[first]
    return (keys >> own).astype(np.int64), keys & ((np.uint64(1) << own) - np.uint64(1)), inverse


def sharded(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by shard, and (shard, first, end) in it of the shards that have any."""
    shard = (hashes % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    ordered = shard[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, list(zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The places of all texts' words in an array of distinct ones, each text's number of words, that array.

    Words as `words_of` has them, and after each text's words the end, which is empty as no word is.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())
    empty = pc.equal(words, b"").to_numpy(zero_copy_only=False)  # beside white space at a text's ends
    end = int(np.argmax(empty)) if empty.any() else len(words)
    there = codes != end
    ends = np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
    codes = np.insert(codes[there].astype(np.int64), ends[1:], end)
    return codes, np.diff(ends) + 1, words if empty.any() else pa.concat_arrays([words, pa.array([b""], pa.binary())])


def text_blocks(docs: DataFrame, held_out: Column, block: int = BLOCK) -> DataFrame:
    """Rows of about `block` tokens: doc_ids, held, lengths, tokens (numbers of words, the frequent ones small), words, counts (in training)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, held, lengths, tokens, met, n = [], [], [], [], [], 0  # tokens: places in each part's words, which met has

        def row() -> dict:
            coded, sizes = pa.concat_arrays(met).dictionary_encode(), np.concatenate(lengths).astype(np.uint32)
            words, cuts = coded.dictionary, np.cumsum([0, *map(len, met)])
            flat = np.concatenate([coded.indices.to_numpy()[a:b][own] for a, b, own in zip(cuts[:-1], cuts[1:], tokens, strict=True)])
            counts = np.bincount(flat, minlength=len(words))
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            learnt = np.bincount(flat[np.repeat(~np.array(held), sizes)], minlength=len(words)).astype(np.uint32)
            return {"doc_ids": [ids], "held": [held], "lengths": [packed(sizes)], "tokens": [packed(place[flat])], "words": [packed_words(words.take(pa.array(order)))], "counts": [packed(learnt[order])], "n": [n]}

        for batch in (x for b in batches for x in pieces(b)):
            codes, sizes, words = coded_words(batch.column(1))
            ends = np.cumsum(sizes)
            doc_ids, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            start = 0
            while start < len(sizes):
                before = ends[start - 1] if start else 0
                stop = min(len(sizes), int(np.searchsorted(ends, before + block - n)) + 1)  # up to the document that fills the block
                own = codes[before : ends[stop - 1]]
                there = np.bincount(own, minlength=len(words)) > 0
                met.append(words.filter(pa.array(there)))
                tokens.append((np.cumsum(there, dtype=np.uint32) - np.uint32(1))[own])
                lengths.append(sizes[start:stop])
                ids += doc_ids[start:stop]
                held += out[start:stop]
                n += len(own)
                start = stop
                if n >= block:
                    yield row()
                    ids, held, lengths, tokens, met, n = [], [], [], [], [], 0
        if n:
            yield row()

    out = by_batch(rows, work, "doc_ids array<bigint>, held array<boolean>, lengths binary, tokens binary, words binary, counts binary, n long")
    return bucketed(out.withColumn("block", F.monotonically_increasing_id()), "blocks", "block")


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word: a sum over its bytes, mixed with their places."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    place = np.arange(len(own)) - np.repeat(ends[:-1] - ends[0], sizes)
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(mixed((place << 8 | own).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))[ends - ends[0]]
        return mixed(sums[1:] - sums[:-1] + sizes.astype(np.uint64))


def count_words(blocks: DataFrame, shards: int) -> DataFrame:
    """Answers (block, shard, counts, numbers) for a block's words, and a row a shard (no block) with n tokens and v words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, counts in single_rows(batches):
            words, counts = unpacked_words(data), unpacked(counts)
            order, parts = sharded(_word_hashes(words), shards)
            yield {"shard": [s for s, _, _ in parts], "block": [block] * len(parts), "words": [packed_words(words.take(pa.array(order[a:b]))) for _, a, b in parts], "counts": [packed(counts[order[a:b]]) for _, a, b in parts]}

    def settle(table: pa.Table) -> pa.Table:
        blocks, shard = table.column("block").to_pylist(), table.column("shard")[0].as_py()
        own = [unpacked_words(x.as_py()) for x in table.column("words")]
        cuts = np.cumsum([0, *map(len, own)])
        coded = pa.concat_arrays(own).dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        total = np.bincount(codes, np.concatenate([unpacked(x.as_py()) for x in table.column("counts")]), len(words)).astype(np.uint64)
        learnt = np.flatnonzero(total)
        order = pc.sort_indices(pa.table({"n": total[learnt], "w": words.take(pa.array(learnt))}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
        number = np.full(len(words), UNKNOWN, np.uint64)
        number[learnt[order]] = FIRST + np.arange(len(learnt)) * shards + shard
        counts, numbers = ([packed(x[codes[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (total, number))
        n = len(blocks)
        return pa.table({
            "block": pa.array([*blocks, None], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int32()),
            "counts": pa.array([*counts, None], pa.binary()), "numbers": pa.array([*numbers, None], pa.binary()),
            "n": pa.array([*[None] * n, int(total.sum())], pa.int64()), "v": pa.array([*[None] * n, len(learnt)], pa.int64()),
        })

    sent = by_batch(blocks.select("block", "words", "counts"), send, "shard int, block long, words binary, counts binary")
    return stored(sent.groupBy("shard").applyInArrow(settle, "block long, shard int, counts binary, numbers binary, n long, v long"), "words")


def numbered(blocks: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """block, ids and counts: the numbers and training counts of each block's words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block, data, answers in single_rows(batches):
            own = unpacked_words(data)
            order, _ = sharded(_word_hashes(own), shards)
            out: dict[str, list] = {"block": [block]}
            for name, column in (("counts", "counts"), ("numbers", "ids")):
                values = np.zeros(len(own), np.uint64)
                values[order] = np.concatenate([unpacked(a[name]) for a in sorted(answers, key=lambda a: a["shard"])])
                out[column] = [packed(values)]
            yield out

    met = words.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "counts", "numbers")).alias("answers"))  # a block's own words
    return bucketed(by_batch(blocks.select("block", "words").join(met, "block"), work, "block long, ids binary, counts binary"), "numbered", "block")


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


#: Bits of an n-gram's number; its shard stands above them.
PLACE = 40


@dataclass
class Level:
    """The distinct n-grams of one length in a block: contexts in order, and for each n-gram its context and its word.

    A context is a word's number for bigrams, above that shard << PLACE | number of the n-gram before the last word.
    """

    length: int
    use: np.ndarray  # which tokens have a known context of that length
    contexts: np.ndarray
    totals: np.ndarray  # their counts in training where those reach `hot`, else 0
    rank: np.ndarray  # of an n-gram's context
    words: np.ndarray
    inverse: np.ndarray  # a used token's n-gram

    def dealt(self, shards: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """rank, word and own (number of the n-gram, -1 for none) in the order in which they are sent, and the shards' parts of it.

        A context that reaches `hot` is cut into parts by the words; it stands in each part once more, with the unknown
        word, to be told what that part gives away.
        """
        cuts = 1 + (self.totals // np.uint64(hot)).astype(np.int64)
        rank, words, own = self.rank, self.words, np.arange(len(self.words))
        part = np.zeros(len(words), np.int64)
        cut = np.flatnonzero(cuts > 1)
        if len(cut):
            part = (mixed(words) % cuts[rank].astype(np.uint64)).astype(np.int64)
            n = cuts[cut]
            rank, words = np.concatenate([rank, np.repeat(cut, n)]), np.concatenate([words, np.full(n.sum(), UNKNOWN, np.uint64)])
            part, own = np.concatenate([part, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]), np.concatenate([own, np.full(n.sum(), -1)])
            order = np.lexsort((words, rank))
            rank, words, part, own = rank[order], words[order], part[order], own[order]
        of = rank if len(cut) else np.arange(len(self.contexts))  # without cuts a context has one shard
        context, part = self.contexts[of], part if len(cut) else np.zeros(len(of), np.int64)
        if self.length == 2:
            with np.errstate(over="ignore"):
                place = mixed(context * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
        else:
            place = (context >> np.uint64(PLACE)) + part.astype(np.uint64)
        order, parts = sharded(place if len(cut) else (place % np.uint64(shards))[rank], shards)
        return rank[order], words[order], own[order], parts


class Block:
    """A block's tokens by the numbers of their words, and its n-grams level by level."""

    def __init__(self, lengths: bytes, tokens: bytes, ids: bytes, counts: bytes, begins: int, shards: int, hot: int):
        self.lengths = unpacked(lengths).astype(np.int64)
        self.tokens = unpacked(tokens, wide=False)
        self.numbers, self.word_counts = unpacked(ids), unpacked(counts)
        self.names = sorted_distinct(np.append(self.numbers, np.array([UNKNOWN, BEGIN], np.uint64)))
        self.ids = np.searchsorted(self.names, self.numbers).astype(np.uint32)[self.tokens]  # places in names
        self.begins, self.shards, self.hot = begins, shards, hot
        self.first = np.zeros(len(self.ids), bool)
        self.first[np.cumsum(self.lengths) - self.lengths] = True

    def level(self, length: int, of: np.ndarray, names: np.ndarray, known: np.ndarray, told: dict[int, int]) -> Level:
        """of: each token's context as a place in names, whose names are distinct; told: counts of contexts that reach `hot`."""
        of = of[known]
        there = np.zeros(len(names), bool)
        there[of] = True
        place = np.flatnonzero(there)
        order = np.argsort(names[place])
        contexts = names[place[order]]
        ranks = np.zeros(len(names), np.uint32)
        ranks[place[order]] = np.arange(len(place))
        rank, words, inverse = distinct_pairs(ranks[of], self.ids[known])
        totals = np.zeros(len(contexts), np.uint64)
        if told:
            names = np.array(sorted(told), np.uint64)
            place = np.minimum(np.searchsorted(names, contexts), len(names) - 1)
            met = names[place] == contexts
            totals[met] = np.array([told[x] for x in names.tolist()], np.uint64)[place[met]]
        return Level(length, known, contexts, totals, rank, self.names[words.astype(np.int64)], inverse)

    def levels(self, answers: list[dict], up_to: int) -> Iterator[tuple[Level, tuple, dict[int, dict]]]:
        """From bigrams on: the level, how it is dealt, and the answers by shard."""
        of, names = np.append(np.uint32(0), self.ids[:-1]), self.names
        of[self.first] = BEGIN  # its place too, as names begin with UNKNOWN and BEGIN
        frequent = np.flatnonzero(self.word_counts >= self.hot)
        told = dict(zip(self.numbers[frequent].tolist(), self.word_counts[frequent].tolist(), strict=True))
        if self.begins >= self.hot:
            told[BEGIN] = self.begins
        known = of != UNKNOWN
        for length in range(2, up_to + 1):
            own = {a["shard"]: a for a in answers if a["level"] == length}
            level = self.level(length, of, names, known, told)
            rank, words, number, parts = dealt = level.dealt(self.shards, self.hot)
            yield level, dealt, own
            if length == up_to:
                return
            names, found, told = np.zeros(len(level.words), np.uint64), np.zeros(len(level.words), bool), {}
            for shard, a, b in parts:
                answer = own[shard]
                seen = np.unpackbits(np.frombuffer(answer["found"], np.uint8), count=b - a).astype(bool)
                own_names = np.cumsum(unpacked(answer["numbers"]), dtype=np.uint64) | np.uint64(shard << PLACE)
                at = number[a:b][seen]  # what is found has a word, so a number of its own
                names[at], found[at] = own_names, True
                if answer["big"]:
                    big = unpacked(answer["big"])
                    told.update(zip(own_names[big[: len(big) // 2].astype(np.int64)].tolist(), big[len(big) // 2 :].tolist(), strict=True))
            of, ended = np.zeros(len(self.ids) + 1, np.uint32), np.zeros(len(self.ids) + 1, bool)
            after = np.flatnonzero(known) + 1
            of[after], ended[after] = level.inverse, found[level.inverse]
            of, known = of[:-1], ended[:-1] & ~self.first
            del level, dealt, own, rank, words, number, parts, ended, after  # before the next level is made

    def last(self, answers: list[dict], length: int) -> tuple[Level, tuple, dict[int, dict]]:
        """The level of that length alone."""
        for found in self.levels(answers, length):
            if found[0].length == length:
                return found
            del found  # its arrays go before the next ones are made
        raise ValueError(length)


LEVEL_COLUMNS = ("level", "shard", "codes", "used", "found", "numbers", "big")
TOLD = "level: int, shard: int, codes: binary, used: binary, found: binary, numbers: binary, big: binary"
LEVEL = "block long, level int, shard int, codes binary, used binary, found binary, numbers binary, big binary"


def count_ngrams(blocks: DataFrame, length: int, shards: int, hot: int, begins: int, top: bool) -> DataFrame:
    """Answers (block, level, shard, codes of shares, used: what each context's shares add up to, found and numbers, big counts).

    blocks: with the answers of the levels below as `told`; top: no level above asks for numbers, so they stay out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in single_rows(batches):
            yield parted(*row)

    def parted(block: int, held: list, lengths: bytes, tokens: bytes, ids: bytes, counts: bytes, told: list | None) -> dict:
        own = Block(lengths, tokens, ids, counts, begins, shards, hot)
        level, (rank, words, number, parts), _ = own.last(told or [], length)
        learnt = np.repeat(~np.array(held), own.lengths)
        n = np.append(np.bincount(level.inverse[learnt[level.use]], minlength=len(level.words)), 0).astype(np.uint32)[number]  # none for -1
        out: dict[str, list] = {k: [] for k in ("shard", "block", "home", "contexts", "sizes", "words", "counts", "totals")}
        for shard, a, b in parts:
            starts = _starts(rank[a:b])
            own_rank = rank[a:b][starts]
            context = level.contexts[own_rank]
            low = context & np.uint64((1 << PLACE) - 1)
            values = (context >> np.uint64(PLACE), _steps(low, context), np.diff(np.append(starts, b - a)), words[a:b], n[a:b], level.totals[own_rank])
            for column, value in zip(out.values(), (shard, block, *map(packed, values)), strict=True):
                column.append(value)
        return out

    def settle(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        sent = []
        for row in zip(*(table.column(c).to_pylist() for c in ("block", "home", "contexts", "sizes", "words", "counts", "totals")), strict=True):
            home, steps = map(unpacked, row[1:3])
            sent.append((row[0], _from_steps(home, steps), *(unpacked(x, wide=False) for x in row[3:])))
        every = sorted_distinct(np.concatenate([s[1] for s in sent]))
        total = np.zeros(len(every), np.int64)  # of contexts that are cut
        places, own, counts = [], [], []
        for _, context, sizes, words, n, totals in sent:
            place = np.searchsorted(every, context)
            if totals.any():
                total[place] = np.maximum(total[place], totals.astype(np.int64))
            seen = n > 0
            places.append(np.repeat(place.astype(np.uint32), sizes)[seen])
            own.append(words[seen])
            counts.append(n[seen])
        rank, own, inverse = distinct_pairs(np.concatenate(places), np.concatenate(own))
        counts = np.bincount(inverse, np.concatenate(counts), len(rank)).astype(np.int64)
        keys = rank.astype(np.uint64) << np.uint64(WORD) | own
        del places, rank, own, inverse
        large = counts >= hot
        out: dict[str, list] = {k: [] for k in ("block", "level", "shard", "codes", "used", "found", "numbers", "big")}
        with memory_mapped(to_bytes(TrieLevel.build(every, keys, counts, total))) as trie:
            trie.decode()
            for block, context, sizes, words, _, _ in sent:
                codes, number, used = trie.lookup(context, sizes, words)
                known = number >= 0
                numbers, big = number[known], None
                if not top and large.any() and len(at := np.flatnonzero(large[numbers])):
                    big = packed(np.concatenate([at, counts[numbers[at]]]).astype(np.uint64))
                row = (block, length, shard, packed(codes), packed(used), None if top else np.packbits(known).tobytes(), None if top else packed(np.diff(numbers, prepend=0).astype(np.uint64)), big)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))

    sent = by_batch(blocks.select("block", "held", "lengths", "tokens", "ids", "counts", "told"), send, "shard int, block long, home binary, contexts binary, sizes binary, words binary, counts binary, totals binary")
    return stored(sent.groupBy("shard").applyInArrow(settle, LEVEL), "ngrams")


def _steps(low: np.ndarray, context: np.ndarray) -> np.ndarray:
    """What is added to the one before, within the contexts of one home."""
    home = context >> np.uint64(PLACE)
    first = np.concatenate([[True], home[1:] != home[:-1]]) if len(home) else np.zeros(0, bool)
    return np.where(first, low, low - np.append(np.uint64(0), low[:-1])) if len(low) else low


def _from_steps(home: np.ndarray, steps: np.ndarray) -> np.ndarray:
    first = _starts(home)
    total = np.cumsum(steps, dtype=np.uint64)
    before = np.repeat(total[first] - steps[first], np.diff(np.append(first, len(home))))
    return home << np.uint64(PLACE) | (total - before)


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER, block: int = BLOCK, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows held out aren't learnt from."""
    spark = docs.sparkSession
    first = text_blocks(docs, held_out, block)
    size = first.agg(F.sum("n").alias("n"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("begins")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["n"] or 0) // shard))
    begins = size["begins"] or 0
    words = count_words(first, shards)
    counted = words.where("block is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, below = counted["n"] or 0, (counted["n"] or 0) + 0.5 * ((counted["v"] or 0) + 1)
    blocks = first.select("block", "doc_ids", "held", "lengths", "tokens").join(numbered(first, words, shards), "block")
    answers: DataFrame | None = None
    rows = blocks.withColumn("told", F.lit(None).cast(f"array<struct<{TOLD}>>"))
    for length in range(2, order + 1):
        level = count_ngrams(rows, length, shards, hot, begins, length == order)
        answers = level if answers is None else answers.unionByName(level)
        # A block's own n-grams; what numbers the level above needs no shares.
        asked = F.struct(*(F.lit(None).cast("binary").alias(c) if c in ("codes", "used") and length < order else F.col(c) for c in LEVEL_COLUMNS))
        met = answers.groupBy("block").agg(F.collect_list(asked).alias("told"))
        rows = blocks.join(met, "block", "left")
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in single_rows(batches):
            yield scored(*row)

    def scored(doc_ids: list, held: list, lengths: bytes, tokens: bytes, ids: bytes, counts: bytes, told: list | None) -> dict:
        own = Block(lengths, tokens, ids, counts, begins, shards, hot)
        count = own.word_counts.astype(float)
        plain = (count + 0.5) / below
        p, base, known = plain[own.tokens], np.log10(plain)[own.tokens], (count > 0)[own.tokens]
        for level, (rank, _, number, parts), by_shard in own.levels(told or [], order):
            codes, used = np.zeros(len(level.words) + 1, np.uint8), np.zeros(len(level.contexts))
            for s, a, b in parts:
                codes[number[a:b]] = unpacked(by_shard[s]["codes"])
                used[rank[a:b][_starts(rank[a:b])]] += unpacked_floats(by_shard[s]["used"])
            p[level.use] = SHARES[codes[:-1]][level.inverse] + np.maximum(1 - used, 0)[level.rank][level.inverse] * p[level.use]
            del level, rank, number, parts, by_shard, codes, used  # before the next level is made
        cuts = np.concatenate([[0], np.cumsum(own.lengths)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[cuts]) for x in (known, base, np.log10(np.maximum(p, 1e-300)))]
        return dict(zip(names, (doc_ids, held, own.lengths, sums[0].astype(np.int64), [n_train] * len(doc_ids), sums[1], sums[2]), strict=True))

    rows = rows.select("doc_ids", "held", "lengths", "tokens", "ids", "counts", "told")
    return by_batch(rows, work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
