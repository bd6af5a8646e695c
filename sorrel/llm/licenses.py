"""Licence scans by a positional index of rare words.

The index maps each word of the licence templates to its postings, templates and places in them. A file is scanned by
its own licence words, those with the highest inverse document frequency in the corpus first: each template takes the
`anchors` rarest of the file's words that it holds, each place of such a word in the file and each posting give a place
where the template would start, and starts are intersected by relative position, within a tolerance of an eighth of the
template for words put in or left out. Where they meet, the template must align: its longest common subsequence with
that part of the file is at least `least` of its words, and the part holds the template's mandatory key phrases. A
template whose key phrases' words aren't all in the file is passed over before that. Beside that, fixed phrases are
found wherever their words stand consecutively.

The document frequencies are counted over all rows, for the words of the templates alone, so they are a few hundred
numbers whatever the corpus. The scan itself is one pass without a shuffle; a very long text costs in proportion to its
words and to the places of its anchors. Null and empty texts have no words and no labels; repeated rows give repeated
results; no documents give no rows. Words of equal frequency are taken in their own order. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, pieces, raw
from sorrel.llm.license_texts import TEMPLATES

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_KEEP = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def license_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(_KEEP).split()


def _words(phrase: str) -> list[bytes]:
    return license_words(phrase.encode())


VOCABULARY = frozenset(w for _, passage, _ in TEMPLATES for w in _words(passage))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Rows, and for each word of the templates the number of rows that hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, seen = 0, Counter()
        for batch in (x for b in batches for x in pieces(b)):
            for text in raw(batch, "text"):
                n += 1
                seen.update(VOCABULARY.intersection(license_words(text)))
        yield {"word": ["", *(w.decode() for w in seen)], "n": [n, *seen.values()]}

    rows = by_batch(documents(docs), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    """Do the phrase's words stand consecutively."""
    return any(words[i : i + len(phrase)] == phrase for i, w in enumerate(words) if w == phrase[0])


class Template:
    """A passage with what a scan needs of it."""

    def __init__(self, label: str, passage: str, keys: tuple[str, ...]):
        self.label, self.words, self.keys = label, _words(passage), [_words(k) for k in keys]
        self.key_words = frozenset(w for k in self.keys for w in k)
        self.slack = max(2, len(self.words) // 8)
        self.places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            self.places[w].append(i)
        self.bits = {w: sum(1 << i for i in at) for w, at in self.places.items()}

    def aligned(self, part: list[bytes]) -> float:
        """Share of the words in the longest common subsequence with part, a bit a word of the template."""
        every = (1 << len(self.words)) - 1
        free = every
        for w in part:
            met = free & self.bits.get(w, 0)
            free = ((free + met) | (free - met)) & every
        return 1 - free.bit_count() / len(self.words)


class Scanner:
    """The index of one corpus."""

    def __init__(self, n_docs: int, df: dict[bytes, int], anchors: int = 6, least: float = 0.8):
        idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 0.5)) for w in VOCABULARY}
        self.rank = {w: i for i, w in enumerate(sorted(VOCABULARY, key=lambda w: (-idf[w], w)))}
        self.anchors, self.least = anchors, least
        self.templates = [Template(*t) for t in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = defaultdict(list)
        self.gates: dict[bytes, list[int]] = defaultdict(list)
        for number, t in enumerate(self.templates):
            for w, at in t.places.items():
                self.postings[w].append((number, at))
            self.gates[min(t.key_words, key=self.rank.__getitem__)].append(number)
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for phrase, label in PHRASES.items():
            self.phrases[_words(phrase)[0]].append((_words(phrase), label))
        self.watched = frozenset(self.gates) | frozenset(self.phrases)

    def matches(self, words: list[bytes], present: frozenset[bytes]) -> dict[str, float]:
        """The labels of templates that align, with their largest shares; present: the watched words of the file."""
        held = VOCABULARY.intersection(words)
        open_ = {t for g in present for t in self.gates.get(g, ()) if self.templates[t].key_words <= held}
        if not open_:
            return {}
        chosen: dict[int, dict[bytes, list[int]]] = {t: {} for t in open_}
        for w in sorted(held, key=self.rank.__getitem__):  # the file's licence words, rarest first
            for t, offsets in self.postings[w]:
                if t in open_ and len(chosen[t]) < self.anchors:
                    chosen[t][w] = offsets
        wanted = {w for own in chosen.values() for w in own}
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        found: dict[str, float] = {}
        for t, own in chosen.items():
            template = self.templates[t]
            starts = sorted((i - o, w) for w, offsets in own.items() for i in places[w] for o in offsets)
            need, slack, n = (1 if len(template.words) <= 12 else 2), template.slack, len(template.words)
            at = 0
            while at < len(starts):
                low, end = starts[at][0], at
                while end < len(starts) and starts[end][0] <= low + 2 * slack:
                    end += 1
                at += 1  # the next start may be the first of a place that aligns
                if len({w for _, w in starts[at - 1 : end]}) >= need:
                    part = words[max(0, low - slack) : max(0, low + 3 * slack + n)]
                    share = template.aligned(part)
                    if share >= self.least and all(holds(part, k) for k in template.keys):
                        found[template.label] = max(found.get(template.label, 0.0), share)
                        at = end
        return found

    def __call__(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = license_words(text)
        present = self.watched.intersection(words)
        if not present:
            return len(words), 0, None, None, "", "", 0.0
        starts: list[int] = []
        base: set[str] = set()
        if not self.phrases.keys().isdisjoint(present):
            for i, w in enumerate(words):
                for phrase, label in self.phrases.get(w, ()):
                    if words[i : i + len(phrase)] == phrase:
                        starts.append(i)
                        base.add(label)
        found = self.matches(words, present)
        score = max([*found.values(), 0.5 if base else 0.0])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score


def scan_licenses(docs: DataFrame, anchors: int = 6, least: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score: the largest share of a template's words that align, 0.5 at least where a fixed phrase stands.
    """
    scanner = Scanner(*document_frequencies(docs), anchors, least)
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            rows = [scanner(t) for t in raw(batch, "text")]
            yield {"doc_id": batch.column(0)} | dict(zip(names, zip(*rows, strict=True), strict=True))

    return by_batch(documents(docs), work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
