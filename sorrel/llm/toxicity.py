"""Toxicity by cumulative-link ordinal regression on sparse text features.

One weight vector is shared by all thresholds: P(severity <= k) = sigmoid(threshold_k - weights . features). Grades
run from 0 (not toxic) to the highest; the score is the expected grade. Labels may be graded already; toxic rows of
binary labels are graded by their margin in a first fit to the two labels, in equal shares, so that the grades rise with
what separates the labels and the shared weights serve all thresholds.

Training reads at most `sample` labelled rows, those with the smallest hash of their id; both the words kept as
features (at most `words`) and the fit come from them, so the model's size and the driver's work don't depend on the
corpus. Tasks make the rows' bags of words and count features; the driver gets the kept features alone. Scoring is one
pass without a shuffle. Null and empty texts have no features and score like the intercept; a very long text is one bag
of words; rows without a label or an id aren't learnt from; of equal texts the one with the smallest id is learnt from;
features of equal z-score are taken in byte order; repeated rows give repeated results; without both labels every
severity is 0; no documents give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, pieces, raw, rows_kept, stored

#: Bounds of what a fit may read and keep.
SAMPLE, WORDS = 12000, 4096
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def text_words(text: bytes) -> list[bytes]:
    """Runs of letters after lower-casing A-Z; every non-ASCII byte counts as part of a letter."""
    return _WORD.findall(text.lower())


def word_features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings of 4 to 7 letters, which stand for families of words."""
    letters = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"^" + letters[:k].encode() for k in (4, 5, 6, 7) if len(letters) >= k)]


@dataclass
class OrdinalModel:
    words: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)  # features of words met lately

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and value of each feature: one plus the logarithm of its count."""
        rows, cols, values = [], [], []
        known = self.known
        for i, text in enumerate(texts):
            counts: Counter[int] = Counter()
            for word, n in Counter(text_words(text)).items():
                found = known.get(word)
                if found is None:
                    found = tuple(self.words[f] for f in word_features(word) if f in self.words)
                    if len(known) >= 1 << 17:
                        known.clear()
                    known[word] = found
                for feature in found:
                    counts[feature] += n
            rows += [i] * len(counts)
            cols += counts.keys()
            values += [1 + np.log(n) for n in counts.values()]
        return np.array(rows, np.int64), np.array(cols, np.int64), np.array(values, float)

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(severity > k) for each text and threshold."""
        if not len(self.thresholds):
            return np.zeros((len(texts), 1))
        rows, cols, values = self.features(texts)
        margin = np.bincount(rows, self.weights[cols] * values, len(texts))
        return _sigmoid(margin[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_words: int, l2: float = 0.02, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by penalised likelihood, with Adam steps.

    Thresholds are a first value and positive gaps, so they stay in order.
    """
    n, top = len(grades), int(grades.max())
    share = np.clip([(grades <= k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(n_words), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    ends = np.eye(top + 2)[grades]  # a one where a row's grade is
    for step in range(1, steps + 1):
        w, cuts = params[:n_words], np.cumsum(np.concatenate([params[n_words : n_words + 1], np.exp(params[n_words + 1 :])]))
        margin = np.bincount(rows, w[cols] * values, n)
        cum = np.hstack([np.zeros((n, 1)), _sigmoid(cuts - margin[:, None]), np.ones((n, 1))])
        p = np.maximum(np.take_along_axis(np.diff(cum, axis=1), grades[:, None], 1)[:, 0], 1e-12)
        slope = cum * (1 - cum)
        upper, lower = np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0] / p, np.take_along_axis(slope, grades[:, None], 1)[:, 0] / p
        d_margin = (upper - lower) / n
        d_cuts = -(ends[:, :top] * upper[:, None] - ends[:, 1 : top + 1] * lower[:, None]).sum(0) / n
        grad = np.concatenate([np.bincount(cols, d_margin[rows] * values, n_words) + l2 * w / n_words**0.5, [d_cuts.sum()], np.cumsum(d_cuts[::-1])[::-1][1:] * np.exp(params[n_words + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_words], np.cumsum(np.concatenate([params[n_words : n_words + 1], np.exp(params[n_words + 1 :])]))


def separating_features(bags: DataFrame, n_toxic: int, n_clean: int, most: int = WORDS, least_z: float = 2.5) -> list[tuple[bytes, float]]:
    """Features whose log-odds of standing in toxic rows differ from chance, at most `most` by z-score; their z-scores.

    Tasks count the rows that hold a feature by label, Spark adds them up and ranks them; what is kept alone is collected.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for grade, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for feature in {f for w in words.split() for f in word_features(w)}:
                    held.setdefault(feature, [0, 0])[grade > 0] += 1
            yield {"feature": list(held), "a": [n[1] for n in held.values()], "b": [n[0] for n in held.values()]}

    counts = by_batch(bags.select("grade", "words"), work, "feature binary, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 5 or b >= 5")
    cells = [F.col("a") + 0.5, F.lit(n_toxic) - F.col("a") + 0.5, F.col("b") + 0.5, F.lit(n_clean) - F.col("b") + 0.5]
    z = (F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])) / F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])
    best = counts.select("feature", z.alias("z")).where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "feature").limit(most)
    return [(bytes(r["feature"]), r["z"]) for r in best.collect()]


def grade_binary(margin: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """0 for rows that aren't toxic, else 1 to grades - 1 by equal shares of the margin."""
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(margin[toxic > 0], np.linspace(0, 1, grades)[1:-1])
        out[toxic > 0] = 1 + np.searchsorted(cuts, margin[toxic > 0], side="left")
    return out


def labelled_bags(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """digest, grade, words and counts of at most `sample` labelled rows; of equal texts the one with the smallest id."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    chosen = chosen.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` short rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            texts = raw(batch, "text")
            bags = [Counter(text_words(t)) for t in texts]
            yield {"doc_id": batch.column(0), "grade": batch.column(2), "digest": [hashlib.md5(t).digest() for t in texts], "words": [b" ".join(c) for c in bags], "counts": [np.array(list(c.values()), "<u4").tobytes() for c in bags]}

    found = by_batch(rows.select("doc_id", "text", "grade"), work, "doc_id long, grade int, digest binary, words binary, counts binary")
    once = found.groupBy("digest").agg(F.min_by(F.struct("grade", "words", "counts"), F.struct("doc_id", "grade")).alias("r"))
    return stored(once.select("digest", "r.*"), "labelled")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", grades: int = 4, sample: int = SAMPLE, words: int = WORDS) -> OrdinalModel:
    """Fits on at most `sample` rows of labels (doc_id and an integer label; over 1: grades already); a text counts once.

    The driver gets the kept features and, for each labelled row, the numbers of those that it holds.
    """
    bags = labelled_bags(docs, labels, label, sample)
    size = {r["toxic"]: r["n"] for r in bags.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    kept = separating_features(bags, size[True], size[False], words) if len(size) == 2 else []
    if not kept:
        return OrdinalModel({}, np.zeros(0), np.zeros(0))
    numbers = {f: i for i, (f, _) in enumerate(kept)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("cols", "counts")}
            for found, often in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                bag: Counter[int] = Counter()
                for word, n in zip(found.split(), np.frombuffer(often, "<u4").tolist(), strict=True):
                    for f in word_features(word):
                        if f in numbers:
                            bag[numbers[f]] += n
                for column, values in zip(out.values(), (bag.keys(), bag.values()), strict=True):
                    column.append(np.fromiter(values, "<i4", len(bag)).tobytes())
            yield out | {"digest": batch.column(0), "grade": batch.column(1)}

    rows = by_batch(bags.select("digest", "grade", "words", "counts"), work, "digest binary, grade int, cols binary, counts binary").orderBy("digest").drop("digest").collect()  # at most `sample`
    cols = [np.frombuffer(r["cols"], "<i4") for r in rows]
    y = np.array([r["grade"] for r in rows], np.int64)
    row, cols = np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols)
    values = 1 + np.log(np.concatenate([np.frombuffer(r["counts"], "<i4") for r in rows]))
    grade = y
    if y.max() == 1:
        first, _ = fit_ordinal(row, cols, values, y, len(kept))
        grade = grade_binary(np.bincount(row, first[cols] * values, len(rows)), y, grades)
    weights, thresholds = fit_ordinal(row, cols, values, grade, len(kept))
    return OrdinalModel(numbers, weights, thresholds)


def clean_rows(docs: DataFrame, model: OrdinalModel, cut: float = 0.3) -> DataFrame:
    """The rows of docs that the model doesn't take for toxic: a chance below cut of a grade over 0."""
    return rows_kept(docs, lambda texts: model.above(texts)[:, 0] < cut)


def score_toxicity(docs: DataFrame, model: OrdinalModel, cut: float = 0.3) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (chance of a grade over 0), grade (likeliest rank), toxic (0 or 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            above = model.above(raw(batch, "text"))
            yield {"doc_id": batch.column(0), "severity": above.sum(1), "p_toxic": above[:, 0], "grade": (above >= 0.5).sum(1), "toxic": (above[:, 0] >= cut).astype(np.int64)}

    return by_batch(documents(docs), work, "doc_id long, severity double, p_toxic double, grade int, toxic int")
