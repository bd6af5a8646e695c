"""Pointers after insertions and lists by a language's order against plain lists."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sorrel.functions import collation as C
from sorrel.operators import pointers


def test_pointers_resolve_to_the_same_rows(spark):
    draw = random.Random(2)
    before = [(o, k, draw.randrange(100)) for o in range(5) for k in range(8)]
    after = [r for r in before if draw.random() < 0.8] + [(o, 100 + k, draw.randrange(100)) for o in range(5) for k in range(6)]
    place = lambda rows, o: [k for _, k in sorted((v, k) for x, k, v in rows if x == o)]
    stored = [(o, f"/list/{i}{tail}") for o in range(5) for i in range(10) for tail in ("/a/0", "")] + [(0, "/other/1/a"), (0, "/list/x/a"), (0, "/list"), (0, None), (0, "/list/99999999999999999999/a")]
    df = lambda rows: spark.createDataFrame(rows, "o int, k int, v int")
    got = pointers.moved(spark.createDataFrame(stored, "o int, p string").withColumn("was", F.col("p")), "p", "list", df(before), df(after), ["o"], ["k"], ["v", "k"]).collect()
    want = []
    for o, p in stored:
        old, new, parts = place(before, o), place(after, o), (p or "").split("/")
        if len(parts) > 2 and parts[1] == "list" and parts[2].isdigit() and int(parts[2]) < len(old) and old[int(parts[2])] in new:
            parts[2] = str(new.index(old[int(parts[2])]))
            want.append((o, "/".join(parts), p))
        else:
            want.append((o, p, p))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_names_in_the_order_of_the_language(spark):
    names = ["ガス", "かす", "カス", "亜鉛", "Alpha", "alpha", "Beta", "いろ", "アイ", "半導体", "", None, " "]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rising = [r["n"] for r in df.orderBy(*C.blanks_last(F.col("n"), False, "ja")).collect()]
    falling = [r["n"] for r in df.orderBy(*C.blanks_last(F.col("n"), True, "ja")).collect()]
    same = lambda x: [n.replace("カス", "かす") for n in x]  # noqa: E731  the two kinds of kana are equal to the language
    assert same(rising[:-3]) == ["alpha", "Alpha", "Beta", "アイ", "いろ", "かす", "かす", "ガス", "亜鉛", "半導体"]
    assert same(falling[:-3]) == same(rising[:-3])[::-1] and {*rising[-3:]} == {*falling[-3:]} == {"", None, " "}


def test_headings_of_readings(spark):
    cases = {"アイ": "あ行", "がす": "か行", "ん": "わ行", "っ": "た行", "ヴ": "その他", "abc": "A", "9": "その他", "": "その他", "漢": "その他", "ぽ": "は行", "ょ": "や行"}
    got = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", C.reading_heading(F.col("t")).alias("h")).collect()}
    assert got == cases
