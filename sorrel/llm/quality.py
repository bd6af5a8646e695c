"""Quality classifier: a regularised quadratic discriminant over transformed statistics of each text.

Each text becomes a short vector of statistics of its bytes, words and lines, transformed by logarithms and logits so
that a Gaussian fits. Each class has its own mean and a covariance shrunk towards the pooled one and the diagonal; the
score is the logistic of the difference of the two log-densities, whose Mahalanobis terms are solved with cached
Cholesky factors.

The fit uses every labelled training row: partitions sum the vectors and their products for each class, so a few
hundred numbers reach the driver whatever the corpus. Statistics are computed once and kept in the shared folder; the
join with the labels moves those short rows alone. Null and empty texts have defined statistics; a very long text has
the same few numbers as any; rows without a label aren't learnt from, of several labels of an id the largest counts;
repeated rows give repeated results; with fewer than two labelled classes the score is the share of class 1 (0.5 without
labels); a score that equals the cut is accepted; no documents give no rows. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.common import by_batch, documents, pieces, raw, rows_kept, stored

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?'\"()-")] = True
_OTHER = ~(_LETTER | _DIGIT | _SPACE | _STOP)
FEATURES = 16
#: Labelled rows that `accepted` reads for its fit at most.
SAMPLE = 50000


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text; all finite, whatever the text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = int(counts.sum())
    words = text.split()
    n_words = len(words)
    often = Counter(words)
    top = max(often.values(), default=0)
    lines = text.split(b"\n")
    p = counts[counts > 0] / max(n, 1)
    pairs = sum(map(bytes.__eq__, words, words[1:])) if n_words > 1 else 0
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)

    def logit(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5 + 0.01 * whole)))

    return [
        float(np.log1p(n)),
        float(np.log((n - counts[_SPACE].sum() + 1) / (n_words + 1))),
        logit(counts[_OTHER].sum(), n),
        logit(counts[_LETTER].sum(), n),
        logit(counts[_STOP].sum(), n),
        logit(counts[_DIGIT].sum(), n),
        logit(counts[_UPPER].sum(), n),
        logit(len(often), n_words),
        logit(top, n_words),
        logit(pairs, n_words),
        logit(lone, n_words),
        logit(len(set(lines)), len(lines)),
        float(np.log((n_words + 1) / len(lines))),
        float(-(p * np.log2(p)).sum()),
        logit(sum(len(w) > 12 for w in often), len(often)),
        logit(sum(n == 1 for n in often.values()), len(often)),
    ]


@dataclass
class Discriminant:
    """means and inverse Cholesky factors by class, the difference of the constants, and a temperature."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    temperature: float
    centre: np.ndarray
    scale: np.ndarray
    share: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        away = [((z - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True)]
        log_density = [c - 0.5 * (a * a).sum(1) for a, c in zip(away, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((log_density[1] - log_density[0]) / self.temperature, -40, 40)))


def fit_discriminant(n: np.ndarray, total: np.ndarray, products: np.ndarray, pooled: float = 0.3, diagonal: float = 0.02, temperature: float = 2.0) -> Discriminant:
    """From each class's count, sum (2 x d) and sum of outer products (2 x d x d)."""
    d, none = total.shape[1], np.zeros((0, 0))
    if n.sum() == 0 or (n < 2).any():
        return Discriminant(none, none, none, 1.0, np.zeros(d), np.ones(d), float(n[1] / n.sum()) if n.sum() else 0.5)
    centre = total.sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / n.sum() - centre**2, 1e-9))
    means = (total / n[:, None] - centre) / scale
    cov = np.array([(products[k] / n[k] - np.outer(total[k], total[k]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)])
    both = (cov * n[:, None, None]).sum(0) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        s = (1 - pooled) * cov[k] + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.maximum(np.diag(s), 1e-3))
        lower = np.linalg.cholesky(s + 1e-6 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(constants), temperature, centre, scale)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats, the vector as an array of doubles, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            x = np.array([statistics(t) for t in raw(batch, "text")]).reshape(-1, FEATURES)
            yield {"doc_id": batch.column(0), "stats": pa.array(list(x), pa.list_(pa.float64()))}

    return by_batch(documents(docs), work, "doc_id long, stats array<double>")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fits on every row of stats that has a 0 or 1 in labels; an id with several labels takes the largest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    size = 1 + FEATURES + FEATURES**2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums = np.zeros((2, size))
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, FEATURES)
            y = np.array(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield {"y": [0, 1], "sums": pa.array(list(sums), pa.list_(pa.float64()))}

    parts = by_batch(stats.join(known, "doc_id").select("stats", "y"), work, "y int, sums array<double>")
    rows = parts.select("y", F.posexplode("sums").alias("at", "value")).groupBy("y", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, size))
    for r in rows:
        sums[r["y"], r["at"]] = r["value"]
    return fit_discriminant(sums[:, 0], sums[:, 1 : 1 + FEATURES], sums[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES))


def score_statistics(stats: DataFrame, model: Discriminant, cut: float = 0.7) -> DataFrame:
    """doc_id, score from 0 to 1 (higher: class 1 likelier) and predicted (1 if score >= cut) for every row of stats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            score = model.score(np.array(batch.column(1).flatten()).reshape(-1, FEATURES))
            yield {"doc_id": batch.column(0), "score": score, "predicted": (score >= cut).astype(np.int64)}

    return by_batch(stats.select("doc_id", "stats"), work, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score cut or more by a model of the labelled ones among them.

    The fit reads at most `sample` labelled rows, those with the smallest hash of their id, so their ids can be sent to
    all tasks and no text is shuffled; every row is judged.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    learnt = docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")  # at most `sample` ids
    model = train(text_statistics(learnt), known)
    return rows_kept(docs, lambda texts: model.score(np.array([statistics(t) for t in texts]).reshape(-1, FEATURES)) >= cut)


def classify(docs: DataFrame, labels: DataFrame, held_out: str = "false", cut: float = 0.7) -> DataFrame:
    """Scores every row; labels of ids for which the SQL condition held_out is true aren't learnt from."""
    stats = stored(text_statistics(docs), "statistics")
    model = train(stats, labels.where(f"not ({held_out})"))
    return score_statistics(stats, model, cut)
