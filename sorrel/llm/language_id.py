"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, runs of what isn't a letter become one space, and each n-gram of one to LONGEST characters that has
a space at its ends at most falls by a hash into a bucket. A language's log-probabilities of the buckets are kept in
fixed point, so a text's sums are integers and don't depend on how rows are cut into batches. The matrix, a column for
each language, is broadcast; a batch is scored as a sparse matrix of documents by buckets in slices of bounded size.

All training rows count, with whole texts. Each task adds up one matrix of languages by buckets and sends what isn't zero;
the sums reach the driver as at most CELLS numbers: the number of buckets is 2^16, or with over 256 languages the largest
power of two that keeps within CELLS. Over 2^14 different labels are no languages and raise an error before any text is
read. A language that is far more frequent than others is added up in every task before anything moves.

Null texts and those without a letter are `und` with score 0; very long texts are cut into slices of characters for both
passes; rows with a null label aren't learnt from; repeated rows count each time and get equal results; of languages that
tie the first by name is taken; without training rows everything is `und`; no documents give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, mixed, pieces

UNKNOWN = "und"
LONGEST = 4
CELLS = 1 << 24  # of the broadcast matrix: 128 MB
MOST_LANGUAGES = 1 << 14
POINT = 20  # binary places of a log-probability
SLICE = 1 << 20  # characters that are looked at together
_SPACE = 32


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter by its Unicode category."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one space for each run of other than letters, and at both ends; empty without letters."""
    text = text.lower()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = _is_letter()[code]
    if not plain.any():
        return np.zeros(0, np.uint32)
    before = np.concatenate([[False], plain[:-1]])
    kept = np.where(plain, code, _SPACE)[plain | before]
    edge = [_SPACE]
    return np.concatenate([edge, kept, edge if plain[-1] else []]).astype(np.uint32)


def n_grams(code: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the places where its n-grams start and their buckets; code as of `letters`, texts one after another."""
    inside = code != _SPACE
    h = np.zeros(len(code), np.uint64)
    whole = np.ones(len(code), bool)  # no space but at the ends
    for n in range(1, LONGEST + 1):
        size = len(code) - n + 1
        if size <= 0:
            return
        with np.errstate(over="ignore"):
            h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(1)
        whole = whole[:size] & inside[n - 2 : n - 2 + size] if n > 2 else whole[:size]
        at = np.flatnonzero(whole if n > 2 else whole & (inside[:size] | inside[n - 1 :]))
        yield at, (mixed(h[at]) % np.uint64(buckets)).astype(np.int64)


def cut(code: np.ndarray, size: int = SLICE) -> Iterator[np.ndarray]:
    """Slices of about size characters at spaces, a space at both ends of each."""
    spaces = np.flatnonzero(code == _SPACE)
    at = 0
    while at < len(code) - 1:
        end = int(spaces[min(np.searchsorted(spaces, at + size), len(spaces) - 1)])
        end = end if end > at else len(code) - 1
        yield code[at : end + 1]
        at = end


def joined(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts (by `letters`) put together in slices of about SLICE characters, with the index of each character's text."""
    held, owner, n = [], [], 0
    for i, text in enumerate(texts):
        for part in cut(text):
            held.append(part)
            owner.append(i)
            n += len(part)
            if n >= SLICE:
                yield np.concatenate(held), np.repeat(owner, [len(x) for x in held])
                held, owner, n = [], [], 0
    if held:
        yield np.concatenate(held), np.repeat(owner, [len(x) for x in held])


@dataclass
class Model:
    """languages in order, prior (fixed point) of each, and the matrix buckets x languages of log-probabilities (fixed point)."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def sums(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts x languages: log of prior and probability, fixed point."""
        out = np.tile(self.prior, (len(texts), 1))
        step = max(1, (1 << 22) // max(1, len(self.languages)))
        for code, owner in joined(texts):
            for at, bucket in n_grams(code, len(self.matrix)):
                for a in range(0, len(at), step):
                    own = owner[at[a : a + step]]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    out[own[first]] += np.add.reduceat(self.matrix[bucket[a : a + step]], first, axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        codes = [letters(t) if t else np.zeros(0, np.uint32) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = self.sums(codes)
        best = total.argmax(1)
        away = (total - total.max(1, keepdims=True)) / float(1 << POINT)
        score = 1 / np.exp(np.maximum(away, -700)).sum(1)
        some = np.array([len(c) > 0 for c in codes], bool)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (1 << POINT)).astype(np.int64)


def fit(languages: list[str], rows: np.ndarray, counts: np.ndarray, smoothing: float = 0.5) -> Model:
    """From the number of training rows of each language and the n-grams in each bucket (languages x buckets)."""
    share = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * counts.shape[1])
    return Model(languages, fixed(np.log(rows / max(1, rows.sum()))), np.ascontiguousarray(fixed(np.log(share)).T))


def train(docs: DataFrame, learn: Column, label: str = "lang") -> Model:
    """Learns from the rows for which learn is true and label isn't null; the number of buckets follows from that of labels."""
    known = docs.where(learn).where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = known.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{label} has over {MOST_LANGUAGES} values, which are no languages")
    languages = [r["lang"] for r in found]
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((1, 0), np.int64))
    buckets = min(1 << 16, 1 << ((CELLS // len(languages)).bit_length() - 1))
    place = {x: i for i, x in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros(len(languages) * buckets, np.int64)
        for batch in (x for b in batches for x in pieces(b)):
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for code, owner in joined([letters(t) for t in batch.column(1).to_pylist()]):
                row = lang[owner] * buckets
                for at, bucket in n_grams(code, buckets):
                    cells, times = np.unique(row[at] + bucket, return_counts=True) if len(n) > 1 << 20 else (slice(None), np.bincount(row[at] + bucket, minlength=len(n)))
                    n[cells] += times
        cells = np.flatnonzero(n)
        yield {"cell": cells, "n": n[cells]}

    counts = np.zeros(len(languages) * buckets, np.int64)
    table = by_batch(known, work, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return fit(languages, np.array([r["count"] for r in found], np.float64), counts.reshape(len(languages), buckets))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior probability, 0 for `und`) of every row; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most CELLS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            lang, score = sent.value.predict(batch.column(1).to_pylist())
            yield {"doc_id": batch.column(0), "lang_pred": lang, "score": score}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, lang_pred string, score double")
