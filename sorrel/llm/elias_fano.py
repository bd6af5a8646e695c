"""Elias-Fano sequences and the levels of an n-gram trie, over flat byte buffers that may be memory-mapped."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.int64)
_NTH = np.full((256, 8), 8, np.int64)  # place of the k-th bit that is set, lowest first
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _k] = _p


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary, with a directory for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.decoded: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        parts = [np.zeros(0, np.uint8)]
        for k in range(0, n if bits else 0, 1 << 15):  # a multiple of 8 values fills whole bytes
            planes = ((values[k : k + (1 << 15), None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            parts.append(np.packbits(planes.ravel(), bitorder="little"))
        packed = np.concatenate(parts)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) + 2 if n else 1) + 63
        flags = np.zeros(size // 64 * 64, np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POPCOUNT[high].reshape(-1, 8).sum(1))]).astype(np.uint32)
        return cls(n, bits, np.concatenate([packed, np.zeros(9, np.uint8)]), high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: Iterator[np.ndarray]) -> EliasFano:
        head = next(arrays)
        return cls(int(head[0]), int(head[1]), next(arrays), next(arrays), next(arrays))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the high bits."""
        before = self.ones.astype(np.int64)
        if not one:
            before = np.arange(len(before)) * 64 - before
        word = np.minimum(np.searchsorted(before, k, side="right") - 1, len(before) - 2)
        rest = k - before[word]
        byte = word * 8
        flip = np.uint8(0 if one else 255)
        for _ in range(7):
            here = _POPCOUNT[self.high[byte] ^ flip]
            go = rest >= here
            rest = np.where(go, rest - here, rest)
            byte = byte + go
            if not go.any():
                break
        return byte * 8 + _NTH[self.high[byte] ^ flip, np.minimum(rest, 7)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        byte = at >> 3
        out = np.zeros(len(i), np.uint64)
        shift = (at & 7).astype(np.uint64)
        for k in range(min(8, -(-(self.low_bits + 7) // 8))):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        out >>= shift
        if self.low_bits > 57:  # the value may reach into a ninth byte
            out |= np.where(shift > 0, self.low[byte + 8].astype(np.uint64) << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (out & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.low_bits) + self._low(i) if self.decoded is None else self.decoded[i]

    def values(self) -> np.ndarray:
        """All elements, decoded at once."""
        out = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        for k in range(0, self.n, 1 << 17):
            i = np.arange(k, min(self.n, k + (1 << 17)))
            out[i] = ((out[i] - i) << self.low_bits) + self._low(i)
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element that is not below x (n if none), and whether it equals x.

        With the sequence decoded it is searched at once, else each one's bucket is.
        """
        x = x.astype(np.int64)
        if self.decoded is not None and self.n:
            index = np.searchsorted(self.decoded, x)
            return index, self.decoded[np.minimum(index, self.n - 1)] == x
        bucket, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        zeros = len(self.high) * 8 - self.n
        inside = bucket < zeros
        h = np.where(inside, bucket, 0)
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        end = self._select(h, False) - h
        stop = end.copy()
        while (open_ := np.flatnonzero(first < end)).size:  # halve the bucket
            mid = (first[open_] + end[open_]) // 2
            below = self._low(mid) < low[open_]
            first[open_] = np.where(below, mid + 1, first[open_])
            end[open_] = np.where(below, end[open_], mid)
        found = inside & (first < stop)
        hit = np.flatnonzero(found)
        found[hit] = self._low(first[hit]) == low[hit]
        return np.where(inside, first, self.n), found


#: Discounted shares are kept as one byte: 0 for none, else exp(-STEP * (code - 1)), rounded down.
STEP = 0.07
SHARES = np.concatenate([[0.0], np.exp(-STEP * np.arange(255))])
#: Bits of a word's number beside its context's rank.
WORD = 36


class TrieLevel:
    """n-grams of one length: sorted contexts, monotone pointers to their successors, successors, shares, what they use.

    A successor is kept relative to its context, as the context's rank in the high bits above the word, so the whole
    level is one rising sequence.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, shares: np.ndarray, used: np.ndarray):
        self.contexts, self.pointers, self.successors, self.shares, self.used = contexts, pointers, successors, shares, used

    @classmethod
    def build(cls, contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray | None = None, discount: float = 0.75) -> TrieLevel:
        """contexts, ascending; keys: rank of the context << WORD | word, ascending; totals: of contexts whose counts stand here in part, else 0.

        An n-gram's place in keys is its number as a context of the level above.
        """
        owner = (keys >> np.uint64(WORD)).astype(np.int64)
        total = np.bincount(owner, counts, len(contexts))
        if totals is not None:
            total = np.where(totals > 0, totals, total)
        share = (counts - discount) / total[owner]
        code = np.minimum(1 + np.ceil(-np.log(share) / STEP - 1e-9), 255).astype(np.uint8)
        code = np.where(SHARES[code] > share + 1e-12, 0, code).astype(np.uint8)
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        here, rank = owner[first], np.cumsum(first) - 1
        used = np.bincount(rank, SHARES[code], len(here)).astype(np.float32)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(here)))])
        words = keys & np.uint64((1 << WORD) - 1)
        return cls(EliasFano.build(contexts[here]), EliasFano.build(pointers), EliasFano.build((rank.astype(np.uint64) << np.uint64(WORD)) | words), code, used)

    def arrays(self) -> list[np.ndarray]:
        return [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.shares, self.used]

    @classmethod
    def of(cls, arrays: Iterator[np.ndarray]) -> TrieLevel:
        return cls(EliasFano.of(arrays), EliasFano.of(arrays), EliasFano.of(arrays), next(arrays), next(arrays))

    def decode(self) -> None:
        """Holds contexts, pointers and successors decoded, for many lookups: 8 bytes an element."""
        for x in (self.contexts, self.pointers, self.successors):
            x.decoded = x.values()

    def lookup(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For contexts with so many words each: the codes of the n-grams' shares, their numbers (-1 if unknown), and what each context's shares add up to (0 if unknown)."""
        rank, known = self.contexts.successor(contexts)
        used = np.zeros(len(contexts), np.float32)
        used[known] = self.used[rank[known]]
        codes, number = np.zeros(len(words), np.uint8), np.full(len(words), -1, np.int64)
        at = np.flatnonzero(np.repeat(known, sizes))
        if len(at):
            r = np.repeat(rank, sizes)[at]
            child, there = self.successors.successor((r << WORD) | words[at].astype(np.int64))
            there &= (child >= self.pointers[r]) & (child < self.pointers[r + 1])
            codes[at[there]] = self.shares[child[there]]
            number[at[there]] = child[there]
        return codes, number, used


def to_bytes(level: TrieLevel) -> bytes:
    """The level's arrays one after the other, each at a multiple of 8 bytes after its kind and length."""
    out = bytearray()
    for a in level.arrays():
        data = a.tobytes()
        out += np.array([np.dtype(a.dtype).num, len(a)], "<i8").tobytes() + data + bytes(-len(data) % 8)
    return bytes(out)


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint32, np.int64, np.float32)}


def from_buffer(buffer: np.ndarray) -> TrieLevel:
    """A level over a buffer of bytes, a memory map for one, without copying."""

    def arrays() -> Iterator[np.ndarray]:
        at = 0
        while at < len(buffer):
            kind, n = buffer[at : at + 16].view("<i8")
            dtype = _KINDS[int(kind)]
            size = int(n) * dtype.itemsize
            yield buffer[at + 16 : at + 16 + size].view(dtype)
            at += 16 + size + -size % 8

    return TrieLevel.of(arrays())


@contextmanager
def memory_mapped(data: bytes) -> Iterator[TrieLevel]:
    """The level in a temporary file of this task, mapped into memory; the file goes with the block."""
    with tempfile.NamedTemporaryFile(prefix="trie-") as file:
        file.write(data)
        file.flush()
        yield from_buffer(np.asarray(np.memmap(file.name, np.uint8, "r")))
