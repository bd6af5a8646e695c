"""Models: held-out accuracy, brute-force scores, and what odd rows give."""

from __future__ import annotations

import math
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.llm import language_model, quality, toxicity
from sorrel.llm.elias_fano import SHARES, WORD, EliasFano, TrieLevel, memory_mapped, to_bytes

HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


@pytest.fixture(scope="module")
def larger(spark):
    d = os.environ.get("TEST_LABELLED_DIR", "/root/testdata/sf0.1")  # enough labelled rows for a share of them
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    model = toxicity.train(docs, labels.where(f"not ({HELD_OUT})"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.score_toxicity(docs, model).join(labels.where(HELD_OUT).withColumnRenamed("toxic", "y"), "doc_id").collect()
    found = Counter((r["toxic"], r["y"]) for r in rows)
    assert found[1, 1] / (found[1, 1] + found[0, 1]) > 0.9
    assert found[1, 0] / (found[1, 0] + found[0, 0]) < 0.01
    for r in rows:
        assert 0 <= r["severity"] <= 3 and r["p_toxic"] <= 1


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    rows = quality.classify(docs, labels, HELD_OUT).join(labels.where(HELD_OUT), "doc_id").collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows)
    assert right / len(rows) > 0.98
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_scores_of_odd_rows(odd_docs, rows, labels):
    for got in (quality.classify(odd_docs, labels).select("doc_id", "score"), toxicity.score_toxicity(odd_docs, toxicity.train(odd_docs, labels)).select("doc_id", F.col("severity").alias("score"))):
        found = got.collect()
        assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows)
        assert all(math.isfinite(r["score"]) for r in found)


def test_models_without_labels(spark, odd_docs, labels, no_docs, rows):
    none = labels.where("false")
    assert {r["score"] for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert {r["severity"] for r in toxicity.score_toxicity(odd_docs, toxicity.train(odd_docs, none)).collect()} == {0.0}
    assert quality.classify(no_docs, labels).count() == 0
    assert toxicity.score_toxicity(no_docs, toxicity.train(no_docs, labels)).count() == 0


def test_ordinal_gradient_finds_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = np.digitize(2 * x + rng.logistic(size=4000), [-2, 1, 3])
    w, cuts = toxicity.fit_ordinal(np.arange(4000), np.zeros(4000, np.int64), x, y, 1, l2=0.0)
    assert abs(w[0] - 2) < 0.2 and np.allclose(cuts, [-2, 1, 3], atol=0.3)


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    d = quality.FEATURES
    mix = rng.normal(size=(2, d, d)) / d**0.5 + np.eye(d)
    x = [rng.normal(size=(500, d)) @ mix[k] + k for k in (0, 1)]
    model = quality.fit_discriminant(np.array([500.0, 500.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), temperature=1.0)
    every = np.concatenate(x)
    z = (every - model.centre) / model.scale
    log = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        away = z - model.means[k]
        log.append(math.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(-np.clip(log[1] - log[0], -40, 40))), atol=1e-6)


def words(text: str) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def plain_scores(rows, order=3):
    """The same model by dictionaries: base scores and interpolated scores with quantised shares."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    texts = [[*words(t), b""] for _, t in rows]
    count = Counter(w for h, t in zip(held, texts, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    one = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    grams: dict[tuple, Counter] = {}
    for h, t in zip(held, texts, strict=True):
        if not h:
            ids = ["<s>", *t]
            for i in range(1, len(ids)):
                for k in range(1, order):
                    if i - k >= 0:
                        grams.setdefault(tuple(ids[i - k : i]), Counter())[ids[i]] += 1
    shares: dict[tuple, dict] = {}
    for context, seen in grams.items():
        share = shares[context] = {}
        for x, c in seen.items():
            s = (c - 0.75) / sum(seen.values())
            code = min(1 + math.ceil(-math.log(s) / 0.07 - 1e-9), 255)
            share[x] = 0.0 if SHARES[code] > s + 1e-12 else SHARES[code]
    rest = {context: 1 - float(np.float32(sum(share.values()))) for context, share in shares.items()}
    out = []
    for (d, _), h, t in zip(rows, held, texts, strict=True):
        ids, total, base = ["<s>", *t], 0.0, 0.0
        for i, w in enumerate(t, 1):
            p = one(w)
            for k in range(1, order):
                context = tuple(ids[i - k : i]) if i >= k else None
                if context in shares:
                    p = shares[context].get(w, 0.0) + rest[context] * p
            total += math.log10(p)
            base += math.log10(one(w))
        out.append((d, h, len(t), sum(count[w] > 0 for w in t), n, base, total))
    return out


@pytest.mark.parametrize("sizes", [{"block": 20000}, {"block": 5000, "shard": 2000, "hot": 30}])
def test_language_model_equals_brute_force(odd_docs, rows, sizes):
    """Also with small shards and with frequent contexts that are cut."""
    got = language_model.score_texts(odd_docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, **sizes).collect()
    key = lambda k: (k[0] is None, k[0] or 0, k[2], k[5])
    found, want = sorted(map(tuple, got), key=key), sorted(plain_scores(rows), key=key)
    assert [k[:5] for k in found] == [k[:5] for k in want]
    for a, b in zip(found, want, strict=True):
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-4 * max(1, abs(b[6])), (a, b)


def test_language_model_without_training_rows(odd_docs, no_docs, rows):
    got = language_model.score_texts(odd_docs, F.lit(True)).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {0}
    assert language_model.score_texts(no_docs, F.lit(False)).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 7, 7, 1000000], list(range(0, 9000, 3)), [3] * 500])
def test_elias_fano(values):
    ef = EliasFano.build(np.array(values, np.uint64))
    n = len(values)
    if n:
        assert ef[np.arange(n)].tolist() == values
    asked = np.unique(np.array([*values, *(x + 1 for x in values), 0, 2000000], np.uint64))
    index, found = ef.successor(asked)
    assert index.tolist() == np.searchsorted(np.array(values, np.uint64), asked).tolist()
    assert found.tolist() == [int(x) in set(values) for x in asked]


def test_trie_distributions_sum_to_one():
    rng = np.random.default_rng(3)
    contexts = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    keys, counts = np.unique((rng.zipf(1.3, 50000) % 300).astype(np.uint64) << np.uint64(WORD) | (rng.zipf(1.2, 50000) % 1000).astype(np.uint64), return_counts=True)
    rank, words = (keys >> np.uint64(WORD)).astype(np.int64), keys & np.uint64((1 << WORD) - 1)
    with memory_mapped(to_bytes(TrieLevel.build(contexts, keys, counts))) as level:
        codes, number, used = level.lookup(contexts, np.bincount(rank, minlength=300), words)
        assert number.tolist() == list(range(len(keys)))
        assert (codes > 0).any() and np.allclose(np.bincount(rank, SHARES[codes], 300), used, atol=1e-5) and (used < 1).all()
        assert level.lookup(contexts[:1] + np.uint64(1), np.array([1]), words[:1])[0].tolist() == [0]


def test_successors_in_many_sequences():
    rng = np.random.default_rng(4)
    for _ in range(500):
        top = int(2 ** rng.uniform(1, 62))
        values = np.unique(rng.integers(0, top, int(rng.integers(1, 300))).astype(np.uint64))
        asked = np.unique(np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 5, 50).astype(np.uint64)]))
        index, found = EliasFano.build(values).successor(asked)
        few = [EliasFano.build(np.concatenate([values, values[-1] + np.arange(1, 400, dtype=np.uint64)])).successor(asked[k : k + 3])[0] for k in range(0, 9, 3)]
        assert (np.concatenate(few) == np.searchsorted(np.concatenate([values, values[-1] + np.arange(1, 400, dtype=np.uint64)]), asked[:9])).all()
        assert (index == np.searchsorted(values, asked)).all() and (found == np.isin(asked, values)).all()


def test_a_block_takes_few_bytes_a_token():
    """With 64-bit places beside each token and sorts by argument it took 96."""
    rng, n = np.random.default_rng(5), 1 << 18
    tokens, numbers = (rng.zipf(1.2, n) % 20000).astype(np.uint32), rng.permutation(20000).astype(np.uint64) + np.uint64(2)
    columns = (np.full(n // 64, 64, np.uint32), tokens, numbers, np.bincount(tokens, minlength=20000).astype(np.uint32))
    tracemalloc.start()
    try:
        block = language_model.Block(*map(language_model.packed, columns), n // 64, 4, 1 << 20)
        (level,) = (level for level, _, _ in block.levels([], 2))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    before = [1 if i % 64 == 0 else int(numbers[tokens[i - 1]]) for i in range(n)]
    assert list(zip(level.contexts[level.rank].tolist(), level.words.tolist(), strict=True)) == sorted({*zip(before, numbers[tokens].tolist(), strict=True)})
    assert peak < 60 * n
