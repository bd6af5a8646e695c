"""Pairs of similar sets within one tile: two blocks of sets, whose memory is bounded, compared as bits.

A set's sketch has the parity of its tokens in each of BITS classes. Each token that only one of two sets has changes one
parity at most, so sketches that differ in more classes than similar sets may differ in tokens rule a pair out. What is
left is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS = 128
#: Sketches compared at once, bits made at once, and pairs of keys in a batch.
ROWS, COLS, CELLS, PAIRS = 128, 1024, 1 << 24, 1 << 17


def _sketches(codes: np.ndarray, n: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sketches' words, each an array over all sets."""
    parts = []
    for low in range(0, len(n), 8192):
        high = min(low + 8192, len(n))
        owner = np.repeat(np.arange(high - low), n[low:high])
        parity = np.bincount(owner * BITS + codes[starts[low] : starts[high]] % BITS, minlength=(high - low) * BITS) & 1
        parts.append(np.packbits(parity.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.uint64))
    words = np.concatenate(parts)
    return [np.ascontiguousarray(words[:, w]) for w in range(words.shape[1])]


def _bits(codes: np.ndarray, n: np.ndarray, starts: np.ndarray, of: np.ndarray, words: int) -> np.ndarray:
    """Whole sets as bits, a row for each of `of`."""
    out = np.empty((len(of), words), np.uint64)
    step = max(1, CELLS // (words * 64))
    for low in range(0, len(of), step):
        own = of[low : low + step]
        sizes = n[own]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1]) + np.repeat(starts[own] - (ends - sizes), sizes)
        cells = np.zeros((len(own), words * 64), bool)
        cells[np.repeat(np.arange(len(own)), sizes), codes[flat]] = True
        out[low : low + step] = np.packbits(cells, axis=1).view(np.uint64)
    return out


def similar(ids: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray | None, bound: float, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of sets of left and right that are similar enough, and their similarity; sets are runs of n ids.

    Without right each pair of left once, and each set with itself. Up to `tokens` different ids all sets are held as
    bits; with more, bits are made for what is compared.
    """
    starts = np.concatenate(([0], np.cumsum(n)))
    different, codes = np.unique(ids, return_inverse=True)
    codes = codes.astype(np.int32)
    words = -(-len(different) // 64)
    sketches = _sketches(codes, n, starts)
    whole = _bits(codes, n, starts, np.arange(len(n)), words) if len(different) <= tokens else None
    one = right is None
    left = left[np.argsort(n[left], kind="stable")]
    right = left if one else right[np.argsort(n[right], kind="stable")]
    sizes = n[right]
    differ = (1 - bound) / (1 + bound)
    xor, count, more, fits = np.empty(ROWS * COLS, np.uint64), np.empty(ROWS * COLS, np.uint8), np.empty(ROWS * COLS, np.uint8), np.empty(ROWS * COLS, bool)
    step = max(1, (1 << 18) // words)

    def common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.empty(len(p), np.int64)
        for low in range(0, len(p), step):
            x, y = p[low : low + step], q[low : low + step]
            if whole is None:
                own, place = np.unique(np.concatenate((x, y)), return_inverse=True)
                bits = _bits(codes, n, starts, own, words)
                both = bits[place[: len(x)]] & bits[place[len(x) :]]
            else:
                both = whole[x] & whole[y]
            out[low : low + step] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return out

    for i in range(0, len(left), ROWS):
        a = left[i : i + ROWS]
        first, last = np.searchsorted(sizes, [n[a[0]] * bound - 1e-6, n[a[-1]] / bound + 1e-6])
        for j in range(max(first, i) if one else first, last, COLS):
            b = right[j : min(j + COLS, last)]
            shape, area = (len(a), len(b)), len(a) * len(b)
            x, c, m, f = (z[:area].reshape(shape) for z in (xor, count, more, fits))
            np.bitwise_count(np.bitwise_xor(sketches[0][a][:, None], sketches[0][b][None, :], out=x), out=c)
            for w in sketches[1:]:
                c += np.bitwise_count(np.bitwise_xor(w[a][:, None], w[b][None, :], out=x), out=m)
            np.less_equal(c, min(int((n[a[-1]] + n[b[-1]]) * differ + 1e-6), BITS), out=f)
            met = np.flatnonzero(f.ravel())
            r, s = met // len(b), met % len(b)
            p, q = a[r], b[s]
            near = c.ravel()[met] <= (n[p] + n[q]) * differ + 1e-6
            if one:
                near &= r + i <= s + j
            p, q = p[near], q[near]
            both = common(p, q)
            similarity = both / (n[p] + n[q] - both)
            good = (both > 0) & (similarity >= bound)
            if good.any():
                yield p[good], q[good], similarity[good]


def _expanded(p: np.ndarray, q: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each pair's number, its places in p's and q's lists: all keys of one with all of the other, some at once."""
    ends = np.cumsum(sizes_a[p] * sizes_b[q])
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        flat = np.arange(low, min(low + PAIRS, ends[-1]))
        pair = np.searchsorted(ends, flat, side="right")
        width = sizes_b[q[pair]]
        place = flat - (ends[pair] - sizes_a[p[pair]] * width)
        yield pair, place // width, place % width


def key_pairs(table: pa.Table, bound: float, tokens: int, one: bool) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Keys of a and b and their similarity of a tile: rows with side (0, 1), n, ids, keys_a and keys_b (lists of structs of a key).

    With `one` all keys are in keys_a, a tile without side 1 is a block with itself, and each two rows are paired once.
    """
    n, side = table["n"].to_numpy().astype(np.int64), table["side"].to_numpy()
    ids = table["ids"].combine_chunks().flatten().to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = one and not len(right)
    if not len(left) or not (own or len(right)):
        return

    def keys(name: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        lists = table[name].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        return lists.flatten().field(0), sizes, np.cumsum(sizes) - sizes

    (values_a, sizes_a, from_a) = keys("keys_a")
    (values_b, sizes_b, from_b) = (values_a, sizes_a, from_a) if one else keys("keys_b")
    for p, q, similarity in similar(ids, n, left, None if own else right, bound, tokens):
        for pair, i, j in _expanded(p, q, sizes_a, sizes_b):
            if own:  # a set's own keys are paired once
                once = (p[pair] != q[pair]) | (i < j)
                pair, i, j = pair[once], i[once], j[once]
            yield values_a.take(pa.array(from_a[p[pair]] + i)), values_b.take(pa.array(from_b[q[pair]] + j)), similarity[pair]
