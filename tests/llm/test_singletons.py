"""op4_lm_score keeps the n-grams that training holds once."""

from __future__ import annotations

import math
import zlib

from sorrel.llm import queries


def test_ngrams_seen_once_have_their_shares(spark, tmp_path):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    learnt = [i for i in range(200) if i not in held]
    rows = [(learnt[0], "amber birch"), (learnt[1], "cedar dogwood"), (held[0], "amber birch"), (held[1], "amber dogwood")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op4_lm_score(spark, str(tmp_path)).collect()}
    # n = 6 tokens, 5 words; every n-gram after its first word was seen once in its context: 0.25 of the share.
    one, end = 1.5 / 9, 2.5 / 9
    first = 0.25 / 2 + 0.75 * one  # after the begin mark, two successors
    birch = 0.25 + 0.75 * (0.25 + 0.75 * one)  # bigram, and trigram with the begin mark
    last = 0.25 + 0.75 * (0.25 + 0.75 * end)
    assert abs(got[held[0]] - math.log10(first * birch * last)) < 0.06
    assert got[held[0]] > got[held[1]] + 0.5
