"""Operators 1, 6 and 7 and the pipeline's stages end to end against plain versions written anew."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sorrel.llm import media, packing, quality, toxicity

from .test_similar import plain_components


def plain_statistics(text: str) -> list[float]:
    """The sixteen statistics, counted byte by byte."""
    data = text.encode()
    kind = Counter("letter" if chr(b).isalpha() and b < 128 or b > 127 else "digit" if 48 <= b <= 57 else "space" if b in b"\t\n\x0b\x0c\r " else "stop" if b in b".,;:!?'\"()-" else "other" for b in data)
    upper, words, lines = sum(65 <= b <= 90 for b in data), data.split(), data.split(b"\n")
    n, often = len(data), Counter(words)
    logit = lambda a, b: math.log((a + 0.5) / (max(b - a, 0) + 0.5 + 0.01 * b))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0
    return [
        math.log1p(n), math.log((n - kind["space"] + 1) / (len(words) + 1)), logit(kind["other"], n), logit(kind["letter"], n), logit(kind["stop"], n), logit(kind["digit"], n), logit(upper, n),
        logit(len(often), len(words)), logit(max(often.values(), default=0), len(words)), logit(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)), logit(sum(len(w) == 1 and not w.isalnum() for w in words), len(words)),
        logit(len(set(lines)), len(lines)), math.log((len(words) + 1) / len(lines)), entropy, logit(sum(len(w) > 12 for w in often), len(often)), logit(sum(c == 1 for c in often.values()), len(often)),
    ]


def plain_quality(rows, labels) -> list[float]:
    """Shrunken covariances and densities by numpy's own functions."""
    x = np.array([plain_statistics(t) for _, t in rows])
    learnt = [(x[i], labels[d]) for i, (d, _) in enumerate(rows) if d in labels]
    z, y = np.array([a for a, _ in learnt]), np.array([b for _, b in learnt])
    centre, scale = z.mean(0), z.std(0)
    scale = np.sqrt(np.maximum(scale**2, 1e-9))
    z, every = (z - centre) / scale, (x - centre) / scale
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).sum() for k, c in enumerate(covs)) / len(y)
    log = []
    for k, c in enumerate(covs):
        s = 0.7 * c + 0.3 * pooled
        s = 0.98 * s + 0.02 * np.diag(np.maximum(np.diag(s), 1e-3)) + 1e-6 * np.eye(len(s))
        away = every - z[y == k].mean(0)
        log.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away))
    return (1 / (1 + np.exp(-np.clip((log[1] - log[0]) / 2, -40, 40)))).tolist()


def by_id(pairs) -> list:
    return sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))


def test_quality_equals_a_plain_version(odd_docs, rows, labels):
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = by_id((r["doc_id"], r["score"]) for r in quality.classify(odd_docs, labels).collect())
    want = by_id(zip([d for d, _ in rows], plain_quality(rows, known), strict=True))
    assert [a for a, _ in got] == [a for a, _ in want]
    assert np.allclose([b for _, b in got], [b for _, b in want], atol=1e-4)


def plain_toxicity(rows, labels) -> list[float]:
    """Expected grades: features and grades counted with dictionaries, the fit by the same likelihood."""
    texts: dict[str, tuple] = {}
    for d, t in rows:
        if d in labels and (t not in texts or (d, labels[d]) < texts[t]):
            texts[t] = (d, labels[d])
    order = sorted(texts, key=lambda t: __import__("hashlib").md5(t.encode()).digest())
    y = np.array([texts[t][1] for t in order])
    bags = [Counter(f for w in toxicity.text_words(t.encode()) for f in toxicity.word_features(w)) for t in order]
    held = [Counter(f for b, k in zip(bags, y, strict=True) if k == label for f in b) for label in (0, 1)]
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    odds = lambda a, n: math.log((a + 0.5) / (n - a + 0.5))
    z = {f: (odds(held[1][f], n1) - odds(held[0][f], n0)) / math.sqrt(1 / (held[1][f] + 0.5) + 1 / (n1 - held[1][f] + 0.5) + 1 / (held[0][f] + 0.5) + 1 / (n0 - held[0][f] + 0.5)) for f in {*held[0], *held[1]} if max(held[0][f], held[1][f]) >= 5}
    kept = sorted((f for f in z if abs(z[f]) >= 2.5), key=lambda f: (-abs(z[f]), f))[:4096]
    number = {f: i for i, f in enumerate(kept)}
    own = lambda b: {number[f]: 1 + math.log(n) for f, n in b.items() if f in number}
    cells = [(i, c, v) for i, b in enumerate(bags) for c, v in own(b).items()]
    r, c, v = np.array([x[0] for x in cells]), np.array([x[1] for x in cells]), np.array([x[2] for x in cells])
    first, _ = toxicity.fit_ordinal(r, c, v, y, len(kept))
    margin = np.bincount(r, first[c] * v, len(y))
    cuts = np.quantile(margin[y > 0], [1 / 3, 2 / 3])
    grades = np.array([0 if not k else 1 + sum(m > q for q in cuts) for k, m in zip(y, margin, strict=True)])
    w, thresholds = toxicity.fit_ordinal(r, c, v, grades, len(kept))
    out = []
    for _, t in rows:
        m = sum(w[i] * x for i, x in own(Counter(f for word in toxicity.text_words(t.encode()) for f in toxicity.word_features(word))).items())
        out.append(sum(1 / (1 + math.exp(-max(-40, min(40, m - q)))) for q in thresholds))
    return out


def test_toxicity_equals_a_plain_version(odd_docs, rows, labels):
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = by_id((r["doc_id"], r["severity"]) for r in toxicity.score_toxicity(odd_docs, toxicity.train(odd_docs, labels)).collect())
    want = by_id(zip([d for d, _ in rows], plain_toxicity(rows, known), strict=True))
    assert [a for a, _ in got] == [a for a, _ in want]
    assert np.allclose([b for _, b in got], [b for _, b in want], atol=1e-4)


def plain_hash(payload: bytes) -> str:
    """Brightness of each cell of an 8 x 9 grid by the parts of samples that lie in it."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, 24).astype(float)

    def shares(n: int, cells: int) -> np.ndarray:
        out = np.zeros((cells, n))
        for i in range(cells):
            for k in range(n):
                out[i, k] = max(0.0, min((i + 1) * n / cells, k + 1) - max(i * n / cells, k))
        return out / out.sum(1, keepdims=True)

    small = np.round(shares(len(image), 8) @ image @ shares(24, 9).T, 6)
    bits = (small[:, 1:] > small[:, :-1]).astype(int).ravel()
    return f"{int(''.join(map(str, bits)), 2):016x}"


def test_media_features_equal_a_plain_version(odd_docs, rows):
    short = [(d, t) for d, t in rows if len(t) < 20000]
    got = Counter((r["doc_id"], r["feature"]) for r in media.store_and_read(odd_docs.where("length(coalesce(text, '')) < 20000")).collect())
    want = Counter()
    for d, t in short:
        data = t.encode()
        want[d, plain_hash(data + b"\xff" * (-len(data) % 576 if data else 576))] += 1
    assert sum((got - want).values()) <= 0.01 * len(short)  # two ways of adding may round apart where cells are equal


@pytest.mark.parametrize("data", [b"P5\n99999999999999999999999999999999 1\n255\nxx", b"P2\n1 1\n255\n99999999999999999999999999", b"P4\n99999999999999999999 1\nx", b"P5\n100000 100000\n255\nx", b"P6", b"BM" + b"\xff" * 60, b""])
def test_malformed_images_are_errors(spark, data):
    df = spark.createDataFrame([(1, data, "kept", "own")], "k int, media binary, rows string, _media string")
    row = media.media_tiles(df).first()
    assert row["error"] and row["tile"] is None and (row["rows_input"], row["_media"], row["k"]) == ("kept", "own", 1)


def test_stages_equal_plain_versions(spark, sf_dir, odd_docs, rows, labels):
    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    left = [(d, t) for (d, t), s in zip(rows, plain_quality(rows, {k: v[0] for k, v in known.items()}), strict=True) if s >= corpus_pipeline.KEEP_QUALITY]
    ids = lambda pairs: Counter((d, t) for d, t in pairs)
    found = lambda df: Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    kept = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert found(kept) == ids(left) and kept.columns == docs.columns and len(left) < len(rows)
    model_sees = toxicity.train(kept, labels)
    above = model_sees.above([t.encode() for _, t in left])[:, 0]
    left = [p for p, a in zip(left, above, strict=True) if a < corpus_pipeline.DROP_TOXIC]
    kept = corpus_pipeline.drop_toxic(spark, kept, sf_dir)
    assert found(kept) == ids(left)
    groups, _ = plain_components([t for _, t in left])
    first: dict[int, tuple] = {}
    for (d, t), g in zip(left, groups, strict=True):
        if g not in first or (d is None, d or 0) < first[g]:
            first[g] = (d is None, d or 0)
    one = corpus_pipeline.one_of_each(spark, kept, sf_dir)
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in one.collect()) == Counter(first.values()) and one.columns == docs.columns
    pieces = corpus_pipeline.pack(spark, one, sf_dir)
    assert pieces.count() == packing.token_pieces(one, public_tokenizers.path("byte_bpe_50k.json")).count()


def test_texts_of_any_length_are_media(spark):
    text = "abcdefg " * (1 << 23) + "x"  # 64 MiB and a byte
    docs = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string").union(spark.range(1).selectExpr("id", f"concat(repeat('abcdefg ', cast(id + {1 << 23} as int)), 'x')"))  # made in a task, not a literal of the plan
    got = {r["doc_id"]: r for r in media.store_and_read(docs).collect()}
    payload = text.encode() + b"\xff" * (-len(text) % 576)
    assert (got[0]["n_bytes"], got[0]["payload_bytes"], got[0]["payload_sha256"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
    assert got[1]["n_bytes"] == 100


def test_bands_change_no_tile(monkeypatch):
    image = np.random.default_rng(1).integers(0, 256, (301, 24), np.uint8)
    whole = media.area_resize(image, 24, 24)
    monkeypatch.setattr(media, "BAND", 24 * 7)
    assert (media.area_resize(image, 24, 24) == whole).all()
    assert (media.decode(media.encode_bmp(image.tobytes())) == image).all() and media.decode(media.encode_pgm(image.tobytes())).tobytes() == image.tobytes()


def test_columns_of_the_user_stay(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x", "p", "en"), (2, "a b c d e f g", "y", "q", "en"), (3, "other words are here now", "z", "r", "de")], "doc_id long, text string, _row string, row string, lang string")
    got = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {(1, "a b c d e f g", "x", "p", "en"), (3, "other words are here now", "z", "r", "de")}
