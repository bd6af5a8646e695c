"""Tokenizers' ids of whole texts; distinct words are encoded once and kept in a dictionary of bounded size.

The patterns of the byte-level and the word tokenizer always split between a word and the space before the next one, and
at a line break between words. So a column of texts is split at single spaces and line breaks, the distinct pieces' ids
are looked up, and new pieces alone go to the library, many at once: a word of Latin letters as the one pre-token that it
is, anything else as a text of its own. Texts with other white space at a split (two spaces, tabs at an end) go through a pattern that
splits less; texts that hold the string of a special token go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sorrel.llm.common import LATIN, SPACE, UNITS, Kept, env_single_thread

_SPACES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c)))


def byte_characters() -> list[str]:
    """A character for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs pool[start : start + size] one after the other, and where each ends."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return pool[at], ends


class Coded:
    """ids by distinct texts, looked up as Arrow, in two generations of bounded size: what was met lately outlives what was not."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = 1 << 16):
        self.make, self.most = make, most  # make: new texts -> their ids one after the other, and how many each has (-1: none)
        self.young = self.old = (pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each text's begin and how many they are."""
        if len(self.young[0]) > self.most:
            self.old, self.young = self.young, tuple(x[:0] for x in self.young)
        known, pool, start, size = self.young
        at = _places(texts, known)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            rest = texts.take(pa.array(missed))
            before, ids, begin, count = self.old
            place = _places(rest, before)
            held, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            made, sizes = self.make(rest.take(pa.array(new)))
            sizes = np.concatenate([count[place[held]], sizes])
            again, _ = gathered(ids, begin[place[held]], np.maximum(count[place[held]], 0))
            order = np.concatenate([held, new])
            at[missed[order]] = len(known) + np.arange(len(order))
            start = np.concatenate([start, len(pool) + np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)])
            size, pool = np.concatenate([size, sizes]), np.concatenate([pool, again, made])
            self.young = (pa.concat_arrays([known, rest.take(pa.array(order))]), pool, start, size)
        return pool, start[at], size[at]


def _places(texts: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(texts, value_set=known), -1).to_numpy().copy()


def in_a_row(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """ids of all one after the other, and how many each has: -1 for None."""
    return np.frombuffer(b"".join(filter(None, found)), "<u4"), np.array([-1 if f is None else len(f) // 4 for f in found], np.int64)


class TextEncoder:
    """ids of texts as 32-bit integers. Subclasses say how pre-tokens and whole parts are encoded."""

    special: tuple[str, ...] = ()  # strings that the library recognises anywhere in a text
    lower, keeps_space = False, True

    def __init__(self):
        self.table = dict(enumerate(byte_characters()))
        self.words = Coded(self.new_words)
        self.others = Coded(lambda pieces: in_a_row(self._new_others(pieces.to_pylist())))
        self.parts = Kept(self.encode_parts)
        self.stops = self.encode_parts([".", ","])
        self.line = self.encode_parts(["\n"])[0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """ids of words of Latin letters, a space before each or not."""
        raise NotImplementedError

    def new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of such words one after the other, and how many each has."""
        return in_a_row(self.encode_words(words.to_pylist()))

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """ids of any texts, each by itself."""
        raise NotImplementedError

    def mapped(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.table)

    def _new_others(self, pieces: list[str]) -> list[bytes | None]:
        """ids of pieces with the space before them, or none after a line break; None: a piece can't stand alone."""
        out: list[bytes | None] = [None] * len(pieces)
        at = [i for i, p in enumerate(pieces) if p and p[-1] not in _SPACES and (p[1:2] if p[0] == " " else p[0]) not in _SPACES]
        for i, value in zip(at, self.encode_parts([pieces[i] for i in at]), strict=True):
            out[i] = value
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct pieces one after the other, and how many each has: -1 for one that can't stand alone.

        A piece follows a space; one that begins with a line break follows nothing. Words of letters are looked up
        without the stop after them.
        """
        lined = pc.starts_with(pieces, "\n")
        own = pc.if_else(lined, pc.utf8_slice_codeunits(pieces, 1), pieces)
        stops = [pc.ends_with(own, x) for x in ".,"]
        base = pc.if_else(pc.or_(*stops), pc.utf8_slice_codeunits(own, 0, -1), own)
        is_word = pc.match_substring_regex(base, f"^[{LATIN}]+$").to_numpy(zero_copy_only=False)
        first = lined.to_numpy(zero_copy_only=False)
        words = base.filter(pa.array(is_word))
        if self.lower:
            words = pc.utf8_lower(words)
        if self.keeps_space:
            words = pc.binary_join_element_wise(pc.if_else(pa.array(first[is_word]), "", " "), words, "")
        coded = words.dictionary_encode()
        rest = pc.binary_join_element_wise(pc.if_else(lined, "", " "), own, "").filter(pa.array(~is_word))
        pools, starts, sizes = zip(self.words(coded.dictionary), self.others(rest), strict=True)
        fixed = [self.line, *self.stops]
        fixed_sizes = np.array([len(x) // 4 for x in fixed], np.int64)
        fixed_starts = np.cumsum(fixed_sizes) - fixed_sizes
        pool = np.concatenate([np.frombuffer(b"".join(fixed), "<u4"), *pools])
        starts = np.concatenate([starts[0], starts[1] + len(pools[0])]) + fixed_sizes.sum()
        sizes = np.concatenate(sizes)
        entry = np.empty(len(pieces), np.int64)
        entry[is_word] = coded.indices.to_numpy()
        entry[~is_word] = len(coded.dictionary) + np.arange(len(rest))
        start, size = np.zeros((len(pieces), 3), np.int64), np.zeros((len(pieces), 3), np.int64)  # line break, word, stop
        start[:, 0], size[:, 0] = fixed_starts[0], fixed_sizes[0] * first
        start[:, 1], size[:, 1] = starts[entry], sizes[entry]
        for k, ends in enumerate(stops, 1):
            here = ends.to_numpy(zero_copy_only=False) & is_word
            start[here, 2], size[here, 2] = fixed_starts[k], fixed_sizes[k]
        alone = size[:, 1] >= 0
        size[~alone] = 0
        ids, _ = gathered(pool, start.ravel(), size.ravel())
        return ids, np.where(alone, size.sum(1), -1)

    def _whole(self, texts: list[str]) -> list[bytes]:
        """ids of texts that single spaces and line breaks can't split."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self.encode_parts([text])[0]
            else:
                plain.append(i)
        for i, found in zip(plain, self.parts([UNITS.findall(texts[i]) for i in plain]), strict=True):
            out[i] = b"".join(found)
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and where each text's end in them."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lined = pc.utf8_slice_codeunits(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n"), texts, pa.scalar("")), "\n", " \n"), 1)
        split = pc.split_pattern(lined, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        pool, sizes = self._pieces(coded.dictionary)
        begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        codes = coded.indices.to_numpy()
        size, start, first = sizes[codes], begin[codes], offsets[:-1]
        empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        hard = np.minimum.reduceat(size, first) < 0
        if self.special:
            hard |= pc.match_substring(texts, os.path.commonprefix(self.special)).to_numpy(zero_copy_only=False)
        hard &= ~empty
        line = len(self.line) // 4
        size[first] -= line  # nothing stands before a text's first piece
        start[first] += line
        size[np.repeat(hard, np.diff(offsets))] = 0
        size[first[empty]] = 0
        rows = np.flatnonzero(hard)
        if len(rows):
            own = self._whole(texts.take(pa.array(rows)).to_pylist())
            lengths = np.array([len(x) // 4 for x in own], np.int64)
            start[first[rows]] = len(pool) + np.cumsum(lengths) - lengths
            size[first[rows]] = lengths
            pool = np.concatenate([pool, np.frombuffer(b"".join(own), "<u4")])
        ids, ends = gathered(pool, start, size)
        return ids.astype(np.uint32, copy=False), ends[offsets[1:] - 1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian 32-bit bytes."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        data, cuts = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class LibraryEncoder(TextEncoder):
    """The tokenizers library's encode(text, add_special_tokens=False), by a file in its format.

    special_as_text: the strings of special tokens in a text are ordinary text; else they become their ids, as the
    library does unless told otherwise.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        env_single_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, "rb") as file:
            added = [] if special_as_text else json.load(file)["added_tokens"]
        self.special = tuple(t["content"] for t in added)
        plain = [t for t in added if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.between = (plain[0]["content"], plain[0]["id"]) if plain else None  # what stands beside it is encoded by itself
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.keeps_space = len(self.tokenizer.encode(" a", add_special_tokens=False).ids) != 0 and self.tokenizer.encode(" a", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids
        # Where a suffix marks the end of each word, words go to the model many at once and are told apart by it.
        suffix, names = self.model.end_of_word_suffix, self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends: np.ndarray | None = None
        if suffix and all(c + suffix in names for c in byte_characters()):
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[k for name, k in names.items() if name.endswith(suffix)]] = True
            self.plain = Tokenizer(self.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        super().__init__()

    def new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.ends is None:
            return super().new_words(words)
        listed, keep = words.to_pylist(), self.table | {32: " "}
        texts = [" ".join(listed[k : k + 256]) for k in range(0, len(listed), 256)]
        texts = [t if t.isascii() else t.encode().decode("latin-1").translate(keep) for t in texts]
        found = self.plain.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(listed):
            raise ValueError("a word without an end")
        return ids, sizes

    def encode_words(self, words: list[str]) -> list[bytes]:
        tokenize, space = self.model.tokenize, self.table[32]
        flat: list[int] = []
        ends: list[int] = []
        for w in words:
            flat += [t.id for t in tokenize(w.replace(" ", space) if w.isascii() else self.mapped(w))]
            ends.append(4 * len(flat))
        data = np.array(flat, "<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(parts), 1024):
            out += self._between(parts[k : k + 1024])
        return out

    def _between(self, parts: list[str]) -> list[bytes]:
        """ids of parts, which go to the library many at once with a special token between, where no part holds one."""
        if self.between and len(parts) > 1:
            mark, number = self.between
            groups = [parts[k : k + 32] for k in range(0, len(parts), 32)]
            found = self.tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)
            out: list[bytes] = []
            for group, encoding in zip(groups, found, strict=True):
                ids = np.array(encoding.ids, "<u4")
                cuts = np.flatnonzero(ids == number).tolist()
                if len(cuts) != len(group) - 1 or any(s in p for p in group for s in self.special):
                    break
                data = ids.tobytes()
                out += [data[4 * a + 4 : 4 * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
            else:
                return out
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


_encoders: dict[tuple, TextEncoder] = {}


def kept_encoder(kind: type[TextEncoder], *args: str) -> TextEncoder:
    """One encoder for each worker process, kept between tasks."""
    if (kind, *args) not in _encoders:
        _encoders[kind, *args] = kind(*args)
    return _encoders[kind, *args]
