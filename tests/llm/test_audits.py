"""Operators 11 to 13: held-out accuracy, plain versions over all rows, and what odd rows give."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.llm import divergence, importance, language_id, oracles
from sorrel.llm.queries import QUERIES
from tests.compare import connection, differences

ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "123 ... ---", "en", None), (4, "The the THE thé", "en", "b"), (4, "The the THE thé", "en", "b"), (None, "le la les été", "fr", "c"),
    (None, None, None, None), (5, "word " * 300000, "en", "a"), (6, "x" * 3000000, "de", "a"), (7, "漢字 かな ΑΒΓ", "", ""), (8, "a\x00b\x0bc", "en", "a"), (9, "İSTANBUL ß ǅ", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").where("doc_id > 20")
    df = plain.union(spark.createDataFrame(ODD, SCHEMA)).repartition(4)
    return df.select(*(F.lit("x").alias(c) for c in ("n", "term", "slot", "rank", "part", "weight", "score", "bucket", "cell")), *df.columns).cache()


@pytest.fixture(scope="module")
def odd_rows(odd):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.select("doc_id", "text", "lang", "source").collect()]


@pytest.mark.parametrize("name", ["op12_divergence", "op13_resampling"])
def test_rows_agree_with_sql(spark, sf_dir, name):
    assert not differences(QUERIES[name](spark, sf_dir), oracles_of(name), connection(sf_dir))


def oracles_of(name: str) -> str:
    return {"op12_divergence": oracles.DIVERGENCE, "op13_resampling": oracles.RESAMPLING}[name]


def plain_grams(text: str | None) -> Counter:
    """n-grams of up to four characters with a space at their ends at most, by definition."""
    padded = " " + re.sub(r"[\W\d_]+", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip() + " "
    grams = (padded[i : i + n] for n in range(1, 5) for i in range(len(padded) - n + 1))
    return Counter(g for g in grams if g.strip() and " " not in g[1:-1])


def test_n_grams_are_those_of_the_definition():
    for text in ("The cat, the HAT 12 été", "a", "", "..", "x" * 50, "ß漢字 b", "a b c d"):
        code = language_id.letters(text)
        got = Counter()
        for n, (at, _) in enumerate(language_id.n_grams(code, 1 << 16), 1):
            got.update("".join(map(chr, code[i : i + n])) for i in at.tolist())
        assert got == (plain_grams(text) if len(code) else Counter())


def test_slices_change_no_sum(monkeypatch):
    texts = [language_id.letters(t) for t in ("one two three four five six", "", "été à la mer", "x" * 40, "a")]
    model = language_id.fit(["p", "q"], np.ones(2), np.arange(2 * 64).reshape(2, 64) % 7)
    want = model.sums(texts)
    for size in (1, 5, 17):
        monkeypatch.setattr(language_id, "cut", lambda code, size=size, f=language_id.cut: f(code, size))
        monkeypatch.setattr(language_id, "SLICE", size)
        assert (model.sums(texts) == want).all()


def test_language_model_is_multinomial_bayes(odd, odd_rows):
    model = language_id.train(odd, F.col("lang").isin("fr", "es", "de") | (F.col("lang") == ""))
    learnt = [r for r in odd_rows if r[2] in ("fr", "es", "de", "")]
    assert model.languages == ["", "de", "es", "fr"]
    grams: dict = defaultdict(Counter)
    for _, text, lang, _ in learnt:
        for gram, n in plain_grams(text).items():
            code = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
            h = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for c in code:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c) + np.uint64(1)
            grams[lang][int(language_id.mixed(h)[0] % np.uint64(1 << 16))] += n
    for k, lang in enumerate(model.languages):
        whole = sum(grams[lang].values()) + 0.5 * (1 << 16)
        for b in (0, 1, *list(grams[lang])[:50]):
            assert abs(model.matrix[b, k] / 2**20 - math.log((grams[lang][b] + 0.5) / whole)) < 1e-5


def test_languages_of_odd_rows(odd, odd_rows, no_docs, spark):
    model = language_id.train(odd, F.col("doc_id") > 20)
    got = language_id.identify(odd, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {*model.languages, "und"}
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by_id[6]["lang_pred"] != "und"
    assert language_id.identify(no_docs, model).count() == 0
    none = language_id.train(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    many = spark.range(language_id.MOST_LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language_id.train(many, F.lit(True))
    some = language_id.train(many.where("id < 1000"), F.lit(True))
    assert some.matrix.size <= language_id.CELLS


def test_languages_on_held_out_rows(spark):
    d = os.environ.get("TEST_LABELLED_DIR", "/root/testdata/sf0.1")
    rows = QUERIES["op11_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.99


def plain_audit(rows: list, least: int, top: int) -> set:
    """The audit's rows by loops over texts and whole vocabularies."""
    docs = [(lang or "", source or "", re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            count[s].update(t for t in terms if held[t] >= least)
        every = sum(count.values(), Counter())

        def share(c: Counter, kept=kept) -> list:
            return [1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept]

        p, q = {s: share(c) for s, c in count.items()}, share(every)
        for s in count:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in count if o != s)
            terms = sorted((b - a, t) for a, b, t in zip(p[s], q, kept, strict=True) if count[s][t] and a > b)[:top]
            out |= {(lang, s, part, x.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("least", "top", "chunk", "block"), [(5, 50, 64, 2), (30, 3, 2048, 8), (10**6, 50, 2048, 3)])
def test_audit_equals_plain_version(odd, odd_rows, monkeypatch, least, top, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "BLOCK", block)
    got = [tuple(r) for r in divergence.audit(odd, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(odd_rows, least, top)


def test_shares_are_exact():
    n, whole = np.array([0, 1, 10**6, 7 * 10**12]), 9 * 10**15 // 1000
    assert divergence.share(n, whole).tolist() == [1 + 10**9 * (int(x) + 5) // whole for x in n]


def test_audit_of_nothing(no_docs):
    assert divergence.audit(no_docs).count() == 0


def plain_resample(rows: list, target: list, percent: int, least: int, longest: int, buckets: int) -> Counter:
    """The resampling's rows with each run as a string."""

    def runs(text: str | None) -> tuple[int, list]:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    docs = [(d, *runs(t)) for d, t, *_ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in runs(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((n >= least, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), d, len(f), weight))
    able = sorted((x for x in out if x[0]), key=lambda x: (-x[1], x[2] is None, x[2]))
    drawn = percent * len(able) // 100
    ranks = [*range(1, drawn + 1), *[None] * (len(able) - drawn)]
    return Counter((x[2], x[3], x[4], x[1], k) for x, k in zip(able, ranks, strict=True)) + Counter((x[2], x[3], x[4], x[1], None) for x in out if not x[0])


@pytest.mark.parametrize(("percent", "least", "longest", "buckets"), [(25, 20, 2, 10000), (100, 0, 1, 7), (50, 3, 4, 997)])
def test_resampling_equals_plain_version(spark, odd, odd_rows, sf_dir, percent, least, longest, buckets):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.resample(odd, target, percent, least, longest, buckets).collect())
    assert got == plain_resample(odd_rows, texts, percent, least, longest, buckets)


def test_resampling_of_nothing(spark, odd, odd_rows, no_docs, sf_dir):
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert importance.resample(no_docs, target).count() == 0
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.resample(odd, target).collect())
    assert got == plain_resample(odd_rows, [], 25, 20, 2, 10000)


def test_words_are_not_cut():
    text = (" ".join(f"w{i}" for i in range(3000)) + "é" * 5000 + " end").encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text)
    for size in (1, 7, 100, 10**6):
        assert [w for s in importance.word_slices(text, size) for w in s] == words
