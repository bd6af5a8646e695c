"""Fingerprints, media, SimHash groups and licence scans against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sorrel.llm import licenses, media, simhash, sketch
from sorrel.llm.license_texts import TEMPLATES


def test_edits_follow_descending_ids(odd_docs, rows):
    got = sketch.fingerprint_edits(odd_docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(t)
        edited = t[: n - n // 2] + following[: n // 2]
        a, e, f = (sketch.sketch(x.encode()) for x in (t, edited, following))
        want[d, n, hashlib.sha256(edited.encode()).hexdigest(), sketch.to_string(a), sketch.to_string(e), sketch.resemblance(a, e), sketch.resemblance(a, f)] += 1
    assert Counter(map(tuple, got)) == want


def jaccard(a: str, b: str) -> float:
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 0.9, 1.0])
def test_likeness_estimates_jaccard(share):
    words = [f"w{i}" for i in range(4000)]
    other = [f"v{i}" if i >= share * 4000 else w for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(other)
    found = sketch.resemblance(sketch.sketch(a.encode()), sketch.sketch(b.encode()))
    assert abs(found - jaccard(a, b)) < 0.15
    assert abs(sketch.distinct(sketch.sketch(a.encode())) - 3996) < 1200


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(3000)]
    first, both = sketch.sketch(" ".join(words[:1500]).encode()), sketch.sketch(" ".join(words).encode())
    second = sketch.sketch(" ".join(words[1496:]).encode())
    assert (sketch.merge(first, second) == both).all()
    assert sketch.containment(first, both) > 0.8 and abs(sketch.containment(both, first) - 0.5) < 0.2
    df = spark.createDataFrame([("a", sketch.to_string(first)), ("a", sketch.to_string(second)), ("b", sketch.to_string(first))], "k string, fingerprint string")
    got = {r["k"]: [h + (1 << 63) for h in r["hashes"]] for r in sketch.merged(df, "k").collect()}
    assert got == {"a": both.tolist(), "b": first.tolist()}


def test_media_store_is_lossless(odd_docs, rows):
    got = media.store_and_read(odd_docs).collect()
    want = Counter()
    for d, t in rows:
        data = t.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        stored = media.to_npy(np.frombuffer(payload, np.uint8).reshape(-1, 24, 24))
        want[d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest()] += 1
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    by_text = {r["payload_sha256"]: r["feature"] for r in got}
    assert all(by_text[r["payload_sha256"]] == r["feature"] for r in got)


def test_images_decode():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    assert (media.decode(b"P5 # note\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P6\n3 4 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n7 5\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == np.array([[0, 255, 0], [255, 0, 255]])).all()
    rows = b"".join(r[:, ::-1].tobytes().ljust(12, b"\0") for r in colour[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 4, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == colour).all()


def test_area_resize_is_the_mean_of_areas():
    rng = np.random.default_rng(2)
    image = rng.random((6, 8))
    fine = np.repeat(np.repeat(image, 5, 0), 3, 1)  # 30 x 24 divides by 5 and 4
    want = fine.reshape(5, 6, 4, 6).mean((1, 3))
    assert np.allclose(media.area_resize(image, 5, 4), want)


def test_media_column_reports_errors(spark):
    df = spark.createDataFrame([(1, media.encode_pgm(bytes(range(48)))), (2, b"junk"), (3, None), (4, b"P5\n9 9\n255\nshort"), (5, b"BM" + bytes(60))], "rows long, media binary")
    got = media.media_tiles(df.withColumnRenamed("rows", "k")).orderBy("k").collect()
    assert [r["error"] is None for r in got] == [True, False, False, False, False]
    assert media.from_npy(bytes(got[0]["tile"])).shape == (24, 24)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text: str) -> int:
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int], most: int = 4) -> list[int]:
    x = np.array(prints, np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= most
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates_equal_brute_force(odd_docs, rows):
    got = simhash.near_duplicates(odd_docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(prints)
    low: dict[int, int] = {}
    for (d, _), c in zip(rows, label, strict=True):
        if d is not None:
            low[c] = min(low.get(c, d), d)
    want = Counter((d, f"{p:016x}", low.get(c)) for (d, _), p, c in zip(rows, prints, label, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("layout", [simhash.THREE, simhash.TWO])
def test_anchors_lose_no_link(layout):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, np.uint64)
    prints = list(base.tolist())
    for x in base.tolist():
        for n in range(1, 6):
            y = x
            for b in rng.choice(64, n, replace=False).tolist():
                y ^= 1 << b
            prints.append(y)
    x = np.unique(np.array(prints, np.uint64))
    at, key, home = simhash.anchors(x, layout=layout)
    own = simhash.anchors(x, layout=layout, homes_only=True)
    assert Counter(zip(own[0].tolist(), own[1].tolist(), strict=True)) == Counter((i, k) for i, k, h in zip(at.tolist(), key.tolist(), home.tolist(), strict=True) if h)
    assert len(own[0]) == len(x) * len(layout.blocks)
    homes: dict[int, set[int]] = {}
    reach: dict[int, set[int]] = {}
    for i, k, h in zip(at.tolist(), key.tolist(), home.tolist(), strict=True):
        reach.setdefault(i, set()).add(k)
        if h:
            homes.setdefault(i, set()).add(k)
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    assert len(a) > 1000
    assert all(homes[i] & reach[j] or homes[j] & reach[i] for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_long_chains_are_one_component(spark):
    chain = [0]
    for k in range(48):
        chain.append(chain[-1] ^ (0b111 << k))
    chain = list(dict.fromkeys(chain))
    links = [(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for p, q in zip(chain, chain[1:], strict=False) for a, b in [(max(p, q), min(p, q))]]
    got = simhash.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["root"] for r in got} == {0}
    assert len({r["fp"] for r in got}) == len(chain) - 1


@pytest.mark.parametrize("options", [{}, {"crowd": 40}, {"layout": simhash.TWO, "crowd": 100}])
def test_a_crowded_anchor(spark, options):
    """Many distinct fingerprints at one anchor: slices, cells and another layout find the same groups."""
    rng = np.random.default_rng(4)
    prints = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (1500, 3)).astype(np.uint64), axis=1) | np.uint64(0xF0F0 << 20))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.edges(df, **options)).collect()}
    label = plain_components(prints.tolist())
    want = {}
    for p, c in zip(prints.view(np.int64).tolist(), label, strict=True):
        want.setdefault(c, set()).add(p)
    got: dict = {}
    for p in prints.view(np.int64).tolist():
        got.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def plain_scan(text: str):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits, labels = [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                hits.append(i)
                labels.add(label)
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def test_license_phrases_equal_brute_force(odd_docs, rows):
    got = licenses.scan_licenses(odd_docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *plain_scan(t)) for d, t in rows)
    for r in got:
        base = set(r["base_labels"].split(",")) - {""}
        own = r["labels"].split(",") if r["labels"] else []
        assert base <= set(own) and own == sorted(set(own)) and 0 <= r["score"] <= 1


def test_templates_are_found_with_small_changes(spark):
    texts = [
        "Released under the MIT License.", "intro\nLicensed under the Apache License, Version 2.0 (the license)", "licensed under the gnu general public license, version 3",
        "licensed under some gnu general public license, version 3", "Licensed under CC BY-NC 4.0", "licensed under the terms of the GNU General Public License, version 3",
        "# SPDX-License-Identifier: BSD-3-Clause", "permission is hereby granted, free of charge, to each person who gets a copy of this software and its associated documentation files",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert got == {0: "mit", 1: "apache,apache-2.0", 2: "gpl,gpl-3.0", 3: "gpl,gpl-3.0", 4: "cc-by,cc-by-nc-4.0", 5: "gpl,gpl-3.0", 6: "bsd-3-clause", 7: "mit"}


def plain_share(a: list[bytes], b: list[bytes]) -> float:
    """Longest common subsequence by the table, as a share of a."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1] / len(a)


def plain_labels(words: list[bytes]) -> dict[str, float]:
    """Every template at every place of the text."""
    found: dict[str, float] = {}
    for label, passage, keys in TEMPLATES:
        own = licenses.license_words(passage.encode())
        slack, phrases = max(2, len(own) // 8), [licenses.license_words(k.encode()) for k in keys]
        if not all(any(words[i : i + len(k)] == k for i in range(len(words))) for k in phrases):
            continue
        for start in range(-slack, len(words)):
            part = words[max(0, start - slack) : max(0, start + len(own) + 3 * slack)]
            if all(any(part[i : i + len(k)] == k for i in range(len(part))) for k in phrases) and len(set(own) & set(part)) >= 0.5 * len(set(own)):
                share = plain_share(own, part)
                if share >= 0.8:
                    found[label] = max(found.get(label, 0.0), share)
    return found


def test_labels_and_scores_equal_brute_force(spark):
    draw = random.Random(8)
    filler = [f"w{i}" for i in range(40)] + ["license", "software", "the", "gnu", "version", "copy"]
    texts = []
    for _, passage, _ in TEMPLATES:
        for damage in (0.0, 0.08, 0.3):
            words = passage.split()
            for _ in range(int(damage * len(words))):
                k = draw.randrange(len(words))
                words[k : k + 1] = draw.choice([[], [words[k], draw.choice(filler)], [draw.choice(filler)]])
            texts.append(" ".join([*draw.choices(filler, k=draw.randrange(40)), *words, *draw.choices(filler, k=draw.randrange(40))]))
    texts += [" ".join(draw.choices(filler, k=200)), " ".join(t for _, t, _ in TEMPLATES[:8])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        words = licenses.license_words(texts[r["doc_id"]].encode())
        want, base = plain_labels(words), plain_scan(texts[r["doc_id"]])[4]
        assert set(r["labels"].split(",")) - {""} == (set(want) | set(base.split(","))) - {""}, texts[r["doc_id"]]
        assert abs(r["score"] - max([*want.values(), 0.5 if base else 0.0])) < 0.05


def test_no_rows(no_docs):
    for f in (sketch.fingerprint_edits, media.store_and_read, simhash.near_duplicates, licenses.scan_licenses):
        assert f(no_docs).count() == 0
