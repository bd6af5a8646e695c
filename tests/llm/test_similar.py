"""Similar documents against brute force over all pairs of shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline
from sorrel.llm import similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    """For each text the smallest index that pairs with a Jaccard similarity of 0.8 or more connect it with."""
    sets, label, links = [shingles(t) for t in texts], list(range(len(texts))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                links += a != b
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return label, links


def near_copies():
    """Chains of near copies around the threshold, and a group that is cut into chunks."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(5000)}"
    texts = []
    for n in (30, 80, 200, 400):
        for _ in range(12):
            text = [word() for _ in range(n)]
            texts.append(" ".join(text))
            for _ in range(4):
                for _ in range(draw.randrange(1, 2 + n // 40)):
                    text[draw.randrange(n)] = word()
                texts.append(" ".join(text))
    return texts


def test_near_copies_equal_brute_force(spark, monkeypatch):
    texts = near_copies()
    want, links = plain_components(texts)
    assert links > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs).collect()} == dict(enumerate(want))
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_chunks_of_a_large_bucket_all_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 3)
    draw = random.Random(6)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        text = list(base)
        for _ in range(draw.randrange(1, 4)):
            text[draw.randrange(120)] = f"x{draw.randrange(1000)}"
        texts.append(" ".join(text))
    want, _ = plain_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs).collect()} == dict(enumerate(want))


def test_odd_rows_equal_brute_force(odd_docs, rows):
    label, _ = plain_components([t for _, t in rows])
    low = {}
    for (d, _), c in zip(rows, label, strict=True):
        if d is not None:
            low[c] = min(low.get(c, d), d)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0)
    assert sorted(map(tuple, similar.similar_documents(odd_docs).collect()), key=key) == sorted(((d, low.get(c)) for (d, _), c in zip(rows, label, strict=True)), key=key)
