"""Fact check, overlap, restatement, markup, archives and streams against plain versions and small cases."""

from __future__ import annotations

import io
import os
import random
import re
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sorrel.functions import markup as M
from sorrel.functions import paragraphs as P
from sorrel.operators import factcheck, overlap, restate
from sorrel.operators import relational as R
from sorrel.plans import catalog
from sorrel.sources import archives


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_misspelt(text, words):
    exact = [(i, i + len(w)) for w in words for i in range(len(text)) if text.startswith(w, i)]
    found = set()
    for w in words:
        for n in (len(w) - 1, len(w), len(w) + 1) if len(w) >= 4 else ():
            for p in range(len(text) - n + 1):
                c = text[p : p + n]
                if (c[:2] == w[:2] or c[-2:] == w[-2:]) and distance(c, w) == 1 and w not in c and re.fullmatch(factcheck.WORDLIKE, c) and not any(a <= p and p + n <= b for a, b in exact):
                    found.add((p, c))
    out = []
    for p, c in sorted(found, key=lambda x: (-len(x[1]), x[0])):
        if all(p + len(c) <= q or q + len(d) <= p for q, d in out):
            out.append((p, c))
    return sorted(out)


@pytest.mark.parametrize("most", [factcheck.SIGNS, 0])
def test_misspelt_names_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(factcheck, "SIGNS", most)
    draw = random.Random(1)
    words = ["alphabet", "betagam", "gamma", "del", "東京電子工業", "two words"]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(4):
            w = list(draw.choice(words))
            for _ in range(draw.randrange(3)):
                k = draw.randrange(len(w))
                w[k : k + 1] = draw.choice([[], [w[k], "x"], ["y"]])
            parts.append("".join(w))
        texts.append(draw.choice([" ", "", "、"]).join(parts))
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc int, text string")
    got: dict = {}
    for r in factcheck.misspelt(df, "doc", "text", words).collect():
        got.setdefault(r["doc"], []).append((r["place"], r["form"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t in enumerate(texts) if (v := plain_misspelt(t, words))}


def test_deletions_of_words_are_not_sent_to_the_driver(spark, tmp_path):
    """A file of few bytes counts as a small side of a join, whatever its rows are exploded to."""
    for name, column in (("forms", "form"), ("words", "word")):
        spark.range(1000).selectExpr(f"concat('Customer', lpad(id, 9, '0')) AS {column}").write.parquet(str(tmp_path / name))
    near = factcheck.near_words(spark.read.parquet(str(tmp_path / "forms")), spark.read.parquet(str(tmp_path / "words")), 1)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.where("distance = 0").count() == 1000


@pytest.mark.parametrize("most", [1, 2])
def test_near_words_equal_all_distances(spark, most):
    draw = random.Random(4)
    words = sorted({"".join(draw.choices("abc", k=draw.randrange(1, 6))) for _ in range(60)})
    forms = sorted({"".join(draw.choices("abc", k=draw.randrange(6))) for _ in range(60)})
    got = factcheck.near_words(spark.createDataFrame([(f,) for f in forms], "form string"), spark.createDataFrame([(w,) for w in words], "word string"), most).collect()
    assert {tuple(r) for r in got} == {(f, w, d) for f in forms for w in words if (d := distance(f, w)) <= most}


SOURCE = "2025年12月期の売上収益は12,345億円となり、従業員数は5,000人です。営業利益 54,321百万円。設立は1998年4月1日。"


@pytest.fixture(scope="module")
def verdicts(spark):
    drafts = [
        (1, "2025年12月期の売上収益は1.2兆円、従業員数は5,000人。"), (2, "売上収益は1.3兆円である[S1]。1998年4月設立。"), (3, "営業利益は543億円、社員は9人。見よ https://a.example/x. 大阪化学と東京エレクトロム"),
        (4, "２０２５年度、海外比率は12%。https://a.example/gone https://b.example/"), (5, None), (6, ""),
    ]
    d = spark.createDataFrame(drafts, "doc int, text string")
    s = spark.createDataFrame([(k, "S1", SOURCE) for k in range(1, 7)], "doc int, source string, text string")
    listed = spark.createDataFrame([(3, "https://A.example/x/", 200), (4, "https://a.example/gone", 404)], "doc int, url string, status int")
    failed = spark.createDataFrame([(4,)], "doc int")
    return {(r["doc"], r["claim"]): r["verdict"] for r in factcheck.check(d, s, listed, ["東京エレクトロン", "大阪化学株式会社"], "doc", "text", failed).collect()}


def test_claims_have_verdicts(verdicts):
    assert verdicts == {
        (1, "2025年12月"): "grounded", (1, "1.2兆円"): "grounded", (1, "5,000人"): "grounded",
        (2, "1.3兆円"): "contradiction", (2, "1998年4月"): "grounded",
        (3, "543億円"): "grounded", (3, "9人"): "unsupported", (3, "https://a.example/x"): "grounded", (3, "大阪化学"): "grounded", (3, "東京エレクトロム"): "contradiction",
        (4, "2025年度"): "grounded", (4, "12%"): "unverifiable", (4, "https://a.example/gone"): "contradiction", (4, "https://b.example/"): "unsupported",
    }


def test_labels_end_at_stops_and_lose_particles():
    rows = factcheck.claim_rows("前期の売上高は100億円、うち（国内）は30億円")
    assert [(r[1], r[6]) for r in rows if r[0] == "number"] == [("100億円", "前期の売上高"), ("30億円", "")]


def test_spans_equal_brute_force(spark):
    draw = random.Random(2)
    sources = ["".join(draw.choices("abcd", k=400)) for _ in range(5)]
    drafts = []
    for _ in range(12):
        text = "".join(draw.choices("abcd", k=40))
        for _ in range(4):
            s, a = draw.choice(sources), draw.randrange(360)
            text += s[a : a + draw.randrange(10, 40)] + "".join(draw.choices("abcdx", k=draw.randrange(9)))
        drafts.append(text)
    for text in drafts:
        for s in sources:
            want = set()
            for i in range(len(text) - 15 + 1):
                if text[i : i + 15] in s:
                    want |= set(range(i, i + 15))
            got = overlap.matching_spans(text, s, 15)
            assert {k for a, b in got for k in range(a, b)} == want and all(b < c for (_, b), (c, _) in zip(got, got[1:], strict=False))
            best = max((n for n in range(len(text)) for i in range(len(text) - n + 1) if text[i : i + n] in s), default=0)
            assert overlap.longest_common(text, s, 1) == best
    a = spark.createDataFrame(list(enumerate(drafts)), "draft int, text string")
    b = spark.createDataFrame(list(enumerate(sources)), "source int, text string")
    got = sorted((r["draft"], r["start"], r["end"], r["text"]) for r in overlap.shared_spans(a, b, "draft", "source", 15).collect())
    want = []
    for k, text in enumerate(drafts):
        held = sorted({i for s in sources for x, y in overlap.matching_spans(text, s, 15) for i in range(x, y)})
        spans = sorted({(x, y) for s in sources for x, y in overlap.matching_spans(text, s, 15)})
        joined: list[list[int]] = []
        for x, y in spans:
            if joined and x <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], y)
            else:
                joined.append([x, y])
        assert sum(y - x for x, y in joined) == len(held)
        want += [(k, x, y, text[x:y]) for x, y in joined]
    assert got == sorted(want) and got


def test_citation_marks_hide_no_run():
    assert overlap.plain("ab[S1]c ｄ　e") == "abcde"


def test_a_long_source_fits_in_memory():
    draw = random.Random(3)
    long = "".join(draw.choices("abcdefghij", k=120000))
    assert overlap.longest_common(long[50000:50700], long, 30) == 700
    assert overlap.longest_common(long, long[1:], 30) == 119999


def period(spark, rows):
    events = [(c, 2024, at, doc, own, std, s, o, seg) for c, at, doc, own, std, s, o, seg in rows]
    return spark.createDataFrame(events, "company string, fy int, at int, doc long, own boolean, standard string, sales double, ordinary double, segments array<struct<member: string, amount: double>>")


def test_restated_periods_are_the_same_in_any_order(spark):
    rows = [
        ("a", 1, 1, True, "jgaap", 1000.4, 50.0, [("X", 600.2), ("Y", 400.0)]),
        ("a", 2, 2, False, "jgaap", 1000.0, 50.0, [("X", 600.0), ("Y", 400.0)]),  # the unit's rounding: nothing changes
        ("a", 3, 3, False, "jgaap", 900.0, 40.0, [("X", 600.0), ("Z", 300.0)]),  # restated, other segments
        ("a", 4, 4, False, "ifrs", 880.0, None, [("X", 880.0)]),  # another standard: ordinary income goes
        ("b", 1, 5, False, "jgaap", 7.0, 1.0, []),  # no row of its own before it
        ("b", 2, 6, True, "jgaap", 70.0, 9.0, []),
        ("c", 1, 7, False, "jgaap", 7.0, 1.0, []),
    ]
    want = {
        "a": (880.0, None, "ifrs", [("X", 880.0)], 4, [(3, "sales", 1000.4, 900.0), (3, "ordinary", 50.0, 40.0), (4, "sales", 900.0, 880.0), (4, "ordinary", 40.0, None), (4, "segments/X", 600.2, 880.0)]),
        "b": (70.0, 9.0, "jgaap", [], 6, []),
    }
    number = lambda x: None if x is None else float(x)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = restate.restated(period(spark, rows), ["company", "fy"], ["at", "doc"]).collect()
        assert {r["company"]: (number(r["sales"]), number(r["ordinary"]), r["standard"], [(s["member"], number(s["amount"])) for s in r["segments"]], r["source"], [(x["doc"], x["path"], number(x["old"]), number(x["new"])) for x in r["revisions"]]) for r in got} == want


def test_pairs_equal_taking_the_best_first(spark):
    draw = random.Random(4)
    pairs = list({(g, a, b): (g, a, b, round(draw.random(), 2)) for g in ("g", "h") for a in range(12) for b in range(10) if draw.random() < 0.6}.values())
    want, used = [], set()
    for g, a, b, s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if s >= 0.15 and (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.append((g, a, b))
    got = R.greedy_pairs(spark.createDataFrame(pairs, "unit string, a int, b int, score double"), "unit", "a", "b", "score", 0.15)
    assert sorted((r["unit"], r["a"], r["b"]) for r in got.collect()) == sorted(want)


def test_places_equal_a_window(spark):
    draw = random.Random(5)
    df = spark.createDataFrame([(draw.choice(["a", "a", "a", "b", None]), draw.choice([1, 2, None]), k) for k in range(2000)], "g string, v int, k int")
    got = {(r["k"], r["place"]) for r in R.places(df, ["g"], [F.col("v").desc_nulls_last(), "k"]).collect()}
    by = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "k")
    assert got == {(r["k"], r["place"]) for r in df.select("k", F.row_number().over(by).alias("place")).collect()}


def test_paragraphs_under_a_budget(spark):
    def chosen(paragraphs, words, keep=6000):
        row = P.under_budget(spark.createDataFrame([(paragraphs,)], "p array<string>"), "p", words, keep).first()
        return [tuple(k) for k in row["kept"]], row["missed"]

    text = ["a" * 300, "Tool word", "b" * 500, "c" * 200, "another tool", "d" * 10]
    assert chosen(text, ["tool"], 300) == ([(1, "Tool word"), (3, "c" * 200), (4, "another tool"), (5, "d" * 10)], False)  # what doesn't fit frees room for others
    assert chosen(["x" * 1000, "y" * 1000], ["none"]) == ([(0, "x" * 1000), (1, "y" * 500)], True)
    assert chosen(["tool " * 200], ["tool"], 250) == ([(0, "tool " * 50)], False)
    assert chosen([], ["tool"]) == ([], True) and chosen(["", "tool", ""], ["tool"]) == ([(1, "tool")], False)


def test_words_of_any_width(spark):
    cases = [("an eda tool", ["EDA"], True), ("freda", ["EDA"], False), ("半 導体", ["半導 体"], True), ("ＥＤＡ！", ["eda"], True), ("x  y", ["x y"], True), ("a", [], False)]
    for text, words, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(P.holds_word(F.col("t"), words)).first()[0] == want


def test_printed_lines_and_encodings(spark):
    df = spark.createDataFrame([("半導\r\n体の x。\nnext \n line\n\n\nz\nlast！\n",), ("",), (None,)], "t string").select(P.printed_paragraphs(F.col("t")).alias("p"))
    assert [r["p"] for r in df.collect()] == [["半導体の x。", "next line", "z last！"], [], None]
    pages = [("日本".encode("euc-jp"), "text/html; charset=EUC-JP", "日本"), ("日本①".encode("cp932"), None, "日本①"), (b"<meta charset='shift_jis'>" + "①".encode("cp932"), "", "<meta charset='shift_jis'>①"), ("é".encode(), "charset=no-such", "é"), (None, "", None), (b"", "", "")]
    df = spark.createDataFrame(pages, "b binary, c string, want string").select(P.decoded(F.col("b"), F.col("c")).alias("got"), "want")
    assert [r["got"] for r in df.collect()] == [w for *_, w in pages]


def test_markdown_forms():
    blocks = M.blocks_of("## A\nx\ny\n\n### B\n- i\n- j\n\n1. k\n\n|a|b|\n|-|-|\n|1|2|\n\nlast")
    assert [b[0] for b in blocks] == ["h2", "p", "h3", "ul", "ol", "table", "p"] and blocks[5][3] == [["a", "b"], ["1", "2"]]
    assert M.visible_length(["- **bold** [link](http://x) [S1]", "|---|", "> q", "ＡＢ"]) == len("bold link") + 1 + 2
    rest, whole, wrong = M.quiz_of("x\n## Q\n### 問1\nWhy?\n1. a\n2. b\n3. c\n4. d\n答え：2\n解説：z\n### 問2\n1. a\n", "Q")
    assert (rest, whole) == ("x", [("Why?", ["a", "b", "c", "d"], 2, "z")]) and wrong == ["question 2: no prompt", "question 2: choices", "question 2: no answer", "question 2: no explanation"]
    assert M.tidy_citations("である。[S1][S2] 次 [S3]") == "である[S1][S2]。 次[S3]" and M.shift_citations("[S9]", 2) == "[S11]"
    assert M.pieces("売上は100億円[S1]です。") == [("text", "売上は", [], ""), ("cite", "100億円", [1], ""), ("text", "です。", [], "")]
    assert [(n, h) for n, h, _ in M.headed_parts("a\n# b\n```\n# c\n```\n### d")] == [(0, ""), (1, "b"), (3, "d")]
    assert M.listed_ids("## 原資料束\n`a-1` `a-1` `B`\n# n\n`c`", "原資料束") == ["a-1"]
    assert [M.heading_of_reading(x) for x in ("アイ", "ｶﾞ", "abc", "9", "")] == ["あ行", "か行", "A", "その他", "その他"]
    assert M.target_words("洗浄(せんじょう)工程", ["Clean", "clean"]) == ["洗浄(せんじょう)工程", "洗浄工程", "洗浄", "Clean"]


def test_pages_give_paragraphs():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><div class='ads'>ad</div><article><h1>Head</h1><p>One  two<br>three</p><p>One two</p><table><tr><td>a</td><td>b</td></tr></table><div aria-hidden='true'>no</div></article><p>outside</p></body></html>"
    assert M.html_paragraphs(page) == ["Head", "One two", "three", "One two", "a b"]
    assert M.html_paragraphs("<p>半 導体</p><p>x y") == ["半導体", "x y"]
    assert M.feed_addresses("<link rel='alternate' type='application/atom+xml' href='/f?a=1&amp;b=2'>", "https://x.example/y") == ["https://x.example/f?a=1&b=2"]


def table(encoding: str, header: str = "値,要素ID,コンテキストID") -> bytes:
    return (header + "\r\n" + '"1,000","x:売上","Now"\r\n').encode(encoding)


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be", "utf-8-sig", "utf-8", "cp932"])
def test_headers_in_japanese(encoding):
    data = table(encoding) if encoding != "utf-16" else table(encoding)
    assert [(r[0], r[2], r[8]) for r in archives.table_rows(data)] == [("x:売上", "Now", "1,000")]


def test_broken_archives_are_rows_with_errors(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", table("utf-8") * 200)
        z.writestr("b.csv", table("utf-8"))
    data = bytearray(out.getvalue())
    data[60:90] = b"\xff" * 30  # within the compressed bytes of a.csv
    bad = [("in/1.zip", bytes(data)), ("in/2.zip", b"PK"), ("in/3.zip", b""), ("in/4.zip", archive_of("a.csv", "no,such,column\r\n1,2,3\r\n".encode())), ("in/5.zip", archive_of("a.csv", bytes(range(128, 256)) * 3))]
    rows = archives.unpacked(spark.createDataFrame(bad, "path string, content binary")).collect()
    errors = {(r["doc_id"], r["file"]) for r in rows if r["error"]}
    assert errors == {("1", "a.csv"), ("2", None), ("3", None), ("4", "a.csv"), ("5", "a.csv")}
    assert [(r["doc_id"], r["value"]) for r in rows if r["error"] is None] == [("1", "1,000")]
    assert archives.unique_headers(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def archive_of(name: str, data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, data)
    return out.getvalue()


def test_streams_without_rows(spark, tmp_path):
    from sorrel.streaming import merges, windows

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k int, at timestamp, v double").parquet(str(tmp_path / "in"))
    assert merges.latest(stream, ["k"], ["at"]).count() == 0
    counted = windows.by_window(stream, "at", "1 day", "2 days", ["k"], {"n": F.count("*")})
    assert windows.settled(counted, ["start", "k"]).count() == 0


def test_general_queries_stay_without_the_corpus_operators(tmp_path):
    """In a copy without the subpackage, its tests and the pipeline, the entry imports and registers the rest."""
    root = Path(__file__).parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; names = e.queries(); assert 'company_rows' in names and set(e.oracle_sql()) <= set(names); assert not any(n == 'pipeline' or n[:2] == 'op' and n[2].isdigit() for n in names)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_marks_of_paragraphs_are_made_once(spark, sf_dir):
    """No filter repeats the steps below it: there they would run again for each paragraph."""
    from sorrel.plans import documents

    plan = documents.chosen_paragraphs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == 1


def test_codes_of_more_than_five_digits(spark, sf_dir, tmp_path):
    """Codes have five digits whatever the customer's key, and a second code differs from any of them."""

    from .compare import connection, differences

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 17 == 0, F.lit(99999).cast(o.schema["o_custkey"].dataType)).otherwise(F.col("o_custkey") + 99990)).limit(500).write.parquet(str(tmp_path / "orders.parquet"))
    assert not differences(catalog.QUERIES["extracted_documents"](spark, str(tmp_path)), catalog.ORACLES["extracted_documents"], connection(str(tmp_path)))


@pytest.mark.parametrize("name", ["page_paragraphs", "news_pages", "quiz_questions", "body_blocks", "glossary_rows", "listed_bundles", "decoded_pages"])
def test_a_file_is_work_of_many_tasks(spark, sf_dir, name):
    """Work in Python isn't one task for each of a file's row groups."""
    assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
