"""Token store, byte-level BPE and packing against the plain libraries."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sorrel.llm import bpe, encoding, packing, token_store


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_returns_what_the_tokenizer_gives(spark, odd_docs, rows, word_ids):
    got = token_store.store_and_read(odd_docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert all(r["verified"] for r in got)
    want = Counter((d, len(i := word_ids(t) + [1]), crc(i)) for d, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    ordered = sorted(got, key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)


def test_store_reads_ids_back_and_shares_chunks(spark, tmp_path, word_ids):
    long = " ".join(f"passage {i * i % 991}" for i in range(3000))
    docs = [(1, "start one " + long), (2, "another start, longer than the first, " + long), (3, long), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(df, public_tokenizers.path("word_bpe_49k.json"), path)
    got = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, path).collect()}
    assert got == {d: word_ids(t) + [1] for d, t in docs}
    chunks = spark.read.parquet(f"{path}/chunks").select("data").collect()
    assert sum(len(c["data"]) for c in chunks) // 2 < 0.5 * sum(map(len, got.values()))


def test_a_broken_chunk_is_reported(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words here"), (2, "other words there")], "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(df, public_tokenizers.path("word_bpe_49k.json"), path)
    chunks = spark.read.parquet(f"{path}/chunks")
    spoilt = [(bytes(r["key"]), bytes(r["data"]) + b"\0\0") for r in chunks.collect()]
    spark.createDataFrame(spoilt, chunks.schema).write.parquet(f"{path}-spoilt/chunks")
    for name in ("recipes", "starts"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{path}-spoilt/{name}")
    assert not any(r["verified"] for r in token_store.read_documents_back(spark, f"{path}-spoilt").collect())


def test_new_words_and_parts_go_to_the_library_many_at_once(monkeypatch, word_ids, byte_ids):
    """No call a word or part; what two generations of the cache hold or lose changes nothing."""
    letters = "aBcdéßöÿz"
    words = ["".join(letters[(k * p + k // 7) % 9] for p in range(1, 2 + k % 9)) for k in range(3000)]
    words = [w + (".", ",", "", "!?", "9'll", "…", "<|", "中x", "\n", "’s")[k % 10] for k, w in enumerate(words)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 3000, 30)] + ["", "<|startoftext|>", "a <|endoftext|>b c"]
    for name, ids_of in (("word_bpe_49k.json", word_ids), ("byte_bpe_50k.json", byte_ids)):
        encoder = encoding.LibraryEncoder(public_tokenizers.path(name))
        encoder.words.most = encoder.others.most = 50
        calls, encode = Counter(), encoder.tokenizer.encode_batch_fast

        class Counted:
            def encode_batch_fast(self, parts, **how):
                calls["texts"] += len(parts)  # noqa: B023
                return encode(parts, **how)  # noqa: B023

        encoder.tokenizer = Counted()
        if name.startswith("word"):
            monkeypatch.setattr(encoder, "encode_words", lambda words: pytest.fail("a call a word"))
        for k in (0, 20, 40, 10, 60, 80, 0):
            got = encoder.encode(texts[k : k + 25])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts[k : k + 25]]
        assert calls["texts"] < 500


def test_joined_checksums():
    parts = [b"", b"abc", b"x" * 1000, b"\0", b"tail"]
    assert token_store.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_bpe_equals_tiktoken_and_decodes(odd_docs, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t in rows:
        ids = library.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True] += 1
    assert Counter(map(tuple, bpe.round_trip(odd_docs, path, public_tokenizers.PATTERN).collect())) == want


def test_packing_places_every_piece(odd_docs, rows, byte_ids):
    got = packing.pack(odd_docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = Counter()
    for d, t in rows:
        ids = byte_ids(t) + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[d, k, s, n, crc(ids[s : s + n])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(n for *_, n, _ in want.elements()) // 1024)
    assert len(by_sequence) <= 1.02 * least + 2


@pytest.mark.parametrize("counts", [{}, {1024: 3}, {700: 2, 600: 2, 300: 2, 424: 1}, {1: 5000}, {513: 10}, {k: k % 7 + 1 for k in range(1, 1025)}])
def test_plans_hold_all_pieces(counts):
    plan = packing.best_two_fit(counts)
    n = sum(counts.values())
    assert plan.n_sequences <= n
    filled = sum(k * v for k, v in counts.items())
    assert plan.n_sequences >= -(-filled // 1024)


def test_best_two_fit_tightens_a_sequence():
    plan = packing.best_two_fit({600: 1, 300: 1, 250: 1, 170: 1}, 1024)  # greedy: 600 + 300; 300 gives way to 250 + 170
    assert sorted(k for k, s in plan.slots.items() if any(x[2] == 0 for x in s)) == [170, 250, 600]


def test_no_rows(no_docs):
    assert token_store.store_and_read(no_docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert bpe.round_trip(no_docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert packing.pack(no_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_checksums_of_many_runs_at_once():
    """A batch's documents together; one after the other, they took most of the time of reading the store."""
    rng = np.random.default_rng(6)
    parts = [rng.bytes(int(k)) for k in [0, 0, 1, 4, *rng.integers(0, 5000, 200), 0]]
    first = np.array([0, 1, 2, 40, 41, 150])
    got = token_store.crc32_runs(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), first)
    assert got.tolist() == [zlib.crc32(b"".join(parts[a:b])) for a, b in zip(first, [*first[1:], len(parts)], strict=True)]
    assert token_store.crc32_runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
