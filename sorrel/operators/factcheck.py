"""Fact check: claims of drafts, what sources say, and a verdict for each claim.

A text is read once, from left to right: addresses and dates are its marks, and what lies between two marks is a stretch
in which amounts and names are looked for. Drafts and sources have the same scanner. The rest is joins: numbers meet on
document, family and band of magnitude, dates and names on equality, addresses on a table of their states. Nothing is
compared across documents.

Misspelt names come from an index of deletions: two words are one edit apart if one of them, or one of its forms with one
letter taken out, is also that of the other. A dictionary is a table of any size; its words and their deletions are the
keys that the distinct forms of all drafts are joined with, and what meets is checked by its distance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.session import kept

# Units with their family and multiplier, suffixes of company names, characters that end a label.
UNITS = {
    "兆円": ("yen", 1e12), "億円": ("yen", 1e8), "百万円": ("yen", 1e6), "千円": ("yen", 1e3), "万円": ("yen", 1e4), "円": ("yen", 1.0),
    "億米ドル": ("usd", 1e8), "億ドル": ("usd", 1e8), "百万米ドル": ("usd", 1e6), "百万ドル": ("usd", 1e6), "米ドル": ("usd", 1.0), "ドル": ("usd", 1.0),
    "万人": ("person", 1e4), "人": ("person", 1.0), "%": ("percent", 1.0), "社": ("company", 1.0), "件": ("count", 1.0), "枚": ("wafer", 1.0), "倍": ("times", 1.0),
    "ナノメートル": ("nm", 1.0), "nm": ("nm", 1.0), "か月": ("month", 1.0), "カ月": ("month", 1.0), "ヶ月": ("month", 1.0),
}
SUFFIXES = ["製作所", "エレクトロニクス", "エレクトロン", "セミコンダクターズ", "セミコンダクター", "ホールディングス", "テクノロジーズ", "テクノロジー", "ソリューションズ", "化学", "電機", "電子", "工業", "株式会社"]
LABEL_STOP = "、。，．「」『』（）()[]【】\n\t 　:：;；/／"
LABEL_TAIL = "はがをのにでともへやからより"
LABEL_MOST, WINDOW, BEFORE = 15, 60, 30
TABLE_UNITS = [1.0, 1e3, 1e4, 1e6, 1e8]  # multipliers that a table's heading may imply for amounts

_UNIT = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))
_NAME = "[一-龥ァ-ヶーA-Za-z]{2,12}"
#: Characters of which a misspelt form consists.
WORDLIKE = r"[0-9A-Za-z一-龥ぁ-んァ-ヶー・&.\-]+"
_DAY = r"(?P<year>\d{4})(?:年(?:(?P<month>\d{1,2})月(?:(?P<day>\d{1,2})日)?|度)?)"
#: What cuts a draft into stretches: an address, or a date of which all but the year may be missing.
MARK = re.compile(rf"(?P<url>https?://[^\s)\]>\"'」』）]+)|{_DAY}")
#: A date of a source may also be written with marks between its numbers.
SOURCE_DAY = re.compile(rf"{_DAY}|(?P<y>\d{{4}})[/.-](?P<m>\d{{1,2}})[/.-](?P<d>\d{{1,2}})")
#: An amount with its unit, or a number that ends there.
AMOUNT = re.compile(rf"(?<![0-9A-Za-z.,/])(?P<number>\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*(?P<unit>{_UNIT})|(?![0-9A-Za-z]))")
COMPANY = re.compile(rf"株式会社{_NAME}|{_NAME}(?:{'|'.join(SUFFIXES)})")
_STOP = re.compile(f"[{re.escape(LABEL_STOP)}]")
#: Pairs of two letters and a length that are sent to all tasks at most, to look at fewer forms; without them all are looked at.
SIGNS = 1 << 18


def readable(text: str | None) -> str:
    """A text without citation marks, in compatibility form."""
    return unicodedata.normalize("NFKC", re.sub(r"\[S\d+\]", "", text or ""))


def amounts(stretch: str) -> Iterator[tuple[re.Match, float, int]]:
    """Matches of AMOUNT with their value and the number of decimals shown."""
    for m in AMOUNT.finditer(stretch):
        whole, _, decimals = m["number"].replace(",", "").partition(".")
        yield m, float(f"{whole}.{decimals or 0}"), len(decimals)


def label_of(head: str) -> str:
    """The words at the end of a text, after the last character that ends a label and without particles behind."""
    return _STOP.split(head.removesuffix("\n")[-LABEL_MOST:])[-1].rstrip(LABEL_TAIL)


def stretches(text: str) -> Iterator[tuple[int, str, re.Match | None]]:
    """The text between marks with its place, and the mark after it."""
    at = 0
    for m in MARK.finditer(text):
        yield at, text[at : m.start()], m
        at = m.end()
    yield at, text[at:], None


def claim_rows(raw: str | None) -> list[tuple]:
    """(kind, claim, start, value, unit, decimals, label, parts of a date) of a text's claims by place, but for misspelt names."""
    out = []
    for at, stretch, mark in stretches(readable(raw)):
        own = [("number", m[0], at + m.start(), value, m["unit"], decimals, label_of(stretch[: m.start()]), []) for m, value, decimals in amounts(stretch) if m["unit"]]
        own += [("proper", m[0], at + m.start(), None, None, 0, "", []) for m in COMPANY.finditer(stretch)]
        out += sorted(own, key=lambda c: c[2])
        if mark and mark["url"]:
            out.append(("url", mark["url"].rstrip(".,;:、。，．"), mark.start(), None, None, 0, "", []))
        elif mark:
            out.append(("date", mark[0], mark.start(), None, None, 0, "", [int(x) for x in mark.group("year", "month", "day") if x]))
    return out


def source_rows(raw: str | None) -> list[tuple]:
    """(start, value, decimals, unit, the text around and before, no parts) of a source's numbers, then (..., parts) of its dates and their shorter forms."""
    text = readable(raw)
    out = [(m.start(), value, decimals, m["unit"], text[max(0, m.start() - WINDOW) : m.start() + WINDOW], text[max(0, m.start() - BEFORE) : m.start()], None) for m, value, decimals in amounts(text)]
    days = {tuple(int(x) for x in m.groups() if x) for m in SOURCE_DAY.finditer(text)}
    return out + [(None, None, None, None, None, None, list(p)) for p in sorted({d[:n] for d in days for n in range(1, len(d) + 1)})]


def words_of(spark, dictionary: DataFrame | Sequence[str]) -> DataFrame:
    """word, one row each, in the form that texts are read in; dictionary: a table with a column word, or a list."""
    df = dictionary if isinstance(dictionary, DataFrame) else spark.createDataFrame([(w,) for w in dictionary], "word string")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"word": [readable(w) for w in frame["word"]]})

    return df.select(F.col("word").cast("string").alias("word")).mapInPandas(work, "word string").where("word <> ''").distinct()


def deletions(word: Column, most: int) -> Column:
    """The word and all its forms with up to `most` letters taken out, one or two."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    forms = F.when(F.length(word) > 0, once(word)).otherwise(F.array().cast("array<string>"))
    if most > 1:
        forms = F.concat(forms, F.flatten(F.transform(forms, lambda x: F.when(F.length(x) > 0, once(x)).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(F.concat(F.array(word), forms))


def near_words(forms: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """form, word and distance (0 to most) of all words near a form; both sides have one row each."""
    # A plan takes a side for as large as its words, not as their deletions, and would send all of these to the driver.
    keyed = lambda df, c: df.select(c, F.explode(deletions(F.col(c), most)).alias("key")).hint("merge")
    met = keyed(forms, "form").join(keyed(words, "word"), "key").select("form", "word").distinct()
    return met.withColumn("distance", F.levenshtein("form", "word")).where(F.col("distance") <= most)


def _windows(drafts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, place, form: the parts of drafts as long as a word or one letter off that may be one or be misspelt.

    One that begins otherwise than its word has the wrong letter there: it ends like a word, and the word's third and
    fourth letters stand where they belong or one place off.
    """
    n = F.length("word")
    near = F.array(n - 1, n, n + 1)
    begins = words.select(F.explode(near).alias("n"), F.concat(F.lit("<"), F.substring("word", 1, 2)).alias("sign"))
    ends = words.where(n >= 4).select(F.explode(near).alias("n"), F.concat(F.lit(">"), F.expr("right(word, 2)")).alias("sign"))
    inner = words.where(n >= 4).select(F.lit(0).alias("n"), F.concat(F.lit("="), F.substring("word", 3, 2)).alias("sign"))
    signs = begins.where("n > 0").unionByName(ends).unionByName(inner).distinct()
    kind = dict(drafts.dtypes)[key]
    rows = signs.limit(SIGNS + 1).collect()
    few = len(rows) <= SIGNS  # else any part of a word's length is looked at
    table: dict[str, list[int]] = {}
    for r in rows if few else []:
        table.setdefault(r["sign"], []).append(r["n"])
    lengths = sorted({r["n"] for r in rows} - {0}) if few else [r["n"] for r in signs.where("n > 0").select("n").distinct().orderBy("n").collect()]

    def parts(stretch: str) -> set[tuple[int, int]]:
        if not few:
            return {(p, p + size) for size in lengths for p in range(len(stretch) - size + 1)}
        two = [stretch[p : p + 2] for p in range(max(1, len(stretch) - 1))]
        begins = {(p, p + size) for p, x in enumerate(two) for size in table.get(f"<{x}", ()) if p + size <= len(stretch)}
        # From where on a part may stand whose beginning alone is wrong.
        known = [f"={x}" in table for x in two] + [False] * 4
        from_ = [any(known[p + 1 : p + 4]) for p in range(len(two))]
        return begins | {(p + 2 - size, p + 2) for p, x in enumerate(two) for size in table.get(f">{x}", ()) if p + 2 >= size and from_[p + 2 - size]}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, at + p, s[p:q]) for k, t in zip(frame[key], frame[text], strict=True) for at, s, _ in stretches(readable(t)) for p, q in sorted(parts(s))]
            yield pd.DataFrame(rows, columns=[key, "place", "form"])

    return drafts.select(key, text).mapInPandas(work, f"{key} {kind}, place int, form string")


def misspelt(drafts: DataFrame, key: str, text: str, dictionary: DataFrame | Sequence[str], taken: DataFrame | None = None) -> DataFrame:
    """key, place, form of what is one edit off a dictionary word of four letters or more, longest first, none overlapping.

    The form begins or ends with the word's two letters, doesn't hold the word whole, consists of WORDLIKE and isn't part
    of a dictionary word that stands there. taken (key, place, size): what begins within it is passed over. A draft is a
    row with a key of its own.
    """
    words = kept(words_of(drafts.sparkSession, dictionary), "words")
    held = kept(_windows(drafts, key, text, words), "forms")
    near = near_words(held.select("form").distinct(), words, 1)
    ends = (F.substring("form", 1, 2) == F.substring("word", 1, 2)) | (F.expr("right(form, 2)") == F.expr("right(word, 2)"))
    wrong = (F.col("distance") == 1) & (F.length("word") >= 4) & ends & ~F.contains("form", F.col("word")) & F.col("form").rlike(f"^{WORDLIKE}$")
    kinds = near.groupBy("form").agg(F.bool_or(F.col("distance") == 0).alias("exact"), F.bool_or(wrong).alias("wrong")).where("exact OR wrong")
    marked = held.hint("merge").join(kinds, "form").select(key, F.struct((-F.length("form")).alias("less"), "place", (F.col("place") + F.length("form")).alias("end"), "form").alias("x"), "exact", "wrong")
    if taken is not None:
        marked = marked.unionByName(taken.select(key, F.struct((-F.col("size")).alias("less"), "place", (F.col("place") + F.col("size")).alias("end"), F.lit(None).cast("string").alias("form")).alias("x"), F.lit(False).alias("exact"), F.lit(False).alias("wrong")))
    # A draft's hits alone are put together here.
    by = marked.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("wrong"), F.col("x")))).alias("found"), F.collect_list(F.when(F.col("exact"), F.col("x"))).alias("whole"), F.collect_list(F.when(F.col("x.form").isNull(), F.col("x"))).alias("taken")).where("size(found) > 0")
    free = F.filter("found", lambda x: ~F.exists("whole", lambda w: (w["place"] <= x["place"]) & (x["end"] <= w["end"])))
    none = F.filter("found", lambda x: F.lit(False))
    chosen = F.aggregate(free, none, lambda got, x: F.when(F.exists(got, lambda g: (x["place"] < g["end"]) & (g["place"] < x["end"])), got).otherwise(F.array_append(got, x)))
    left = F.filter(chosen, lambda x: ~F.exists("taken", lambda t: (t["place"] <= x["place"]) & (x["place"] < t["end"])))
    return by.select(key, F.explode(left).alias("x")).select(key, "x.place", "x.form")


CLAIMS = "kind string, claim string, start int, value double, unit string, decimals int, label string, parts array<int>"


def claims(drafts: DataFrame, key: str, text: str, dictionary: DataFrame | Sequence[str]) -> DataFrame:
    """Claims of each draft (a row with a key of its own), numbered by place; dictionary: a table with a column word, or a list.

    What stands inside an address is part of the address. Null and empty texts have no claims.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *c) for k, t in zip(frame[key], frame[text], strict=True) for c in claim_rows(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "claim", "start", "value", "unit", "decimals", "label", "parts"])

    said = kept(drafts.select(key, text).mapInPandas(work, f"{key} {dict(drafts.dtypes)[key]}, {CLAIMS}"), "said")  # a text is read once
    names = said.where("kind = 'proper'").select(key, F.col("start").alias("place"), F.length("claim").alias("size"))
    wrong = misspelt(drafts, key, text, dictionary, names)
    more = wrong.select(key, F.lit("proper").alias("kind"), F.col("form").alias("claim"), F.col("place").alias("start"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(0).alias("decimals"), F.lit("").alias("label"), F.array().cast("array<int>").alias("parts"))
    order = Window.partitionBy(key).orderBy("start", "kind", "claim")  # one draft's claims
    return said.unionByName(more).select(key, F.row_number().over(order).alias("no"), "kind", "claim", "start", "value", "unit", "decimals", "label", "parts")


def source_facts(sources: DataFrame, key: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Numbers (start, value, decimals, unit, the text around and before) and dates (parts, shorter ones included) of sources (key, source, text)."""
    kinds, names = dict(sources.dtypes), ["s_start", "s_value", "s_decimals", "s_unit", "around", "before", "parts"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, s, *r) for k, s, t in frame[[key, source, text]].itertuples(index=False) for r in source_rows(t)]
            yield pd.DataFrame(rows, columns=[key, source, *names]).astype({"s_start": "Int32", "s_decimals": "Int32"})

    schema = f"{key} {kinds[key]}, {source} {kinds[source]}, s_start int, s_value double, s_decimals int, s_unit string, around string, before string, parts array<int>"
    rows = kept(sources.select(key, source, text).mapInPandas(work, schema), "facts")  # a text is read once
    return rows.where("parts IS NULL").drop("parts"), rows.where("parts IS NOT NULL").select(key, "parts").distinct()


def _unit_map(index: int) -> Column:
    return F.create_map(*(x for u, v in UNITS.items() for x in (F.lit(u), F.lit(v[index]))))


def tolerance(decimals: Column, multiplier: Column) -> Column:
    """Half of the last digit that a number shows, in its base unit."""
    return 0.5 * F.pow(F.lit(10.0), -decimals) * multiplier + 1e-9


def _bands(value: Column, tol: Column) -> Column:
    """Bands of magnitude that a value and its tolerance touch; values whose tolerances overlap share one."""
    low, high = F.greatest(F.abs(value) - tol, F.lit(1e-9)), F.abs(value) + tol
    return F.sequence(F.floor(F.log(low) * 4).cast("int"), F.floor(F.log(high) * 4).cast("int"))


def number_verdicts(found: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """grounded, contradiction or unsupported for each claim (key, no, value, unit, decimals, label) by its document's numbers.

    grounded: a comparable number within the larger of both tolerances, with a pair of the label's letters near it;
    contradiction: another number of the same family right after the same label; else unsupported. A source's number
    stays as it is written: a claim looks for it under each multiplier that it may stand for, so only claims are widened.
    """
    family, mult = _unit_map(0), _unit_map(1)
    c = found.where("kind = 'number'").select(key, "no", "label", family[F.col("unit")].alias("family"), mult[F.col("unit")].alias("mult"), "value", "decimals")
    c = c.withColumn("target", F.col("value") * F.col("mult")).withColumn("tol", tolerance(F.col("decimals"), F.col("mult")))
    one = F.lit(1.0)
    # A number without a unit may have any unit that a table's heading gives an amount of money, else the plain one or the claim's.
    bare = F.when(F.col("family").isin("yen", "usd"), F.array(*map(F.lit, TABLE_UNITS))).otherwise(F.array_distinct(F.array(one, F.col("mult"))))
    ways = F.concat(F.array(F.struct(F.col("family").alias("as"), one.alias("m"))), F.transform(bare, lambda m: F.struct(F.lit("").alias("as"), m.alias("m"))))
    asked = c.withColumn("w", F.explode(ways)).select(key, "no", "label", "w.as", "w.m", "target", "tol").withColumn("band", F.explode(_bands(F.col("target") / F.col("m"), F.col("tol") / F.col("m"))))
    scale = F.when(F.col("s_unit").isNotNull(), mult[F.col("s_unit")]).otherwise(one)
    n = numbers.withColumn("as", F.coalesce(family[F.col("s_unit")], F.lit(""))).withColumn("s_base", F.col("s_value") * scale).withColumn("s_tol", tolerance(F.col("s_decimals"), scale))
    met = asked.join(n.withColumn("band", F.explode(_bands(F.col("s_base"), F.col("s_tol")))), [key, "as", "band"])
    pairs = F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring(F.col("label"), i, F.lit(2)))
    near = (F.length("label") < 2) | F.exists(F.when(F.length("label") >= 2, pairs), lambda p: F.contains(F.col("around"), p))
    away = F.abs(F.col("s_base") * F.col("m") - F.col("target"))
    grounded = met.where((away <= F.greatest("tol", F.col("s_tol") * F.col("m"))) & near).select(key, "no").distinct().withColumn("grounded", F.lit(True))
    other = n.where("s_unit is not null").select(key, F.col("as").alias("family"), "before", "s_base", "s_tol")
    wrong = c.where(F.length("label") >= 2).join(other, [key, "family"]).where(F.contains(F.col("before"), F.col("label")) & (F.abs(F.col("s_base") - F.col("target")) > F.greatest("tol", "s_tol")))
    wrong = wrong.select(key, "no").distinct().withColumn("wrong", F.lit(True))
    rows = c.select(key, "no").join(grounded, [key, "no"], "left").join(wrong, [key, "no"], "left")
    return rows.select(key, "no", F.when(F.col("grounded"), "grounded").when(F.col("wrong"), "contradiction").otherwise("unsupported").alias("verdict"))


def date_verdicts(found: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """grounded if a source of the document has the date, a longer one of it included; else unsupported."""
    known = dates.select(key, "parts").distinct().withColumn("there", F.lit(True))
    rows = found.where("kind = 'date'").select(key, "no", "parts").join(known, [key, "parts"], "left")
    return rows.select(key, "no", F.when(F.col("there"), "grounded").otherwise("unsupported").alias("verdict"))


def url_verdicts(found: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """By a table of listed addresses (key, url, status): not listed, gone, there, or not known."""
    plain = F.lower(F.regexp_replace("claim", "/+$", ""))
    known = listed.select(key, F.lower(F.regexp_replace("url", "/+$", "")).alias("u"), F.lit(True).alias("listed"), "status").dropDuplicates([key, "u"])
    rows = found.where("kind = 'url'").select(key, "no", plain.alias("u")).join(known, [key, "u"], "left")
    state = F.when(F.col("listed").isNull(), "unsupported").when(F.col("status").isin(404, 410), "contradiction").when(F.col("status").between(200, 399), "grounded").otherwise("unverifiable")
    return rows.select(key, "no", state.alias("verdict"))


def name_verdicts(found: DataFrame, sources: DataFrame, key: str, text: str, dictionary: DataFrame | Sequence[str]) -> DataFrame:
    """grounded in the dictionary or in a source of the document; contradiction one or two letters off a dictionary word of three or more; else unsupported.

    Distinct names meet the dictionary, and sources are read for the names alone that it doesn't have.
    """
    words = words_of(found.sparkSession, dictionary).select(F.regexp_replace("word", "株式会社", "").alias("word")).where("word <> ''").distinct()
    rows = found.where("kind = 'proper'").select(key, "no", F.regexp_replace("claim", "株式会社", "").alias("form"))
    near = near_words(rows.select("form").distinct(), words, 2)
    state = kept(near.groupBy("form").agg(F.bool_or(F.col("distance") == 0).alias("exact"), F.bool_or(F.length("word") >= 3).alias("close")), "names")
    rows = rows.join(state, "form", "left")
    asked = rows.where("NOT coalesce(exact, false)").select(key, "no", "form")
    there = asked.join(sources.select(key, F.col(text).alias("_text")), key).where(F.contains("_text", F.col("form"))).select(key, "no").distinct().withColumn("there", F.lit(True))
    verdict = F.when(F.col("exact") | F.col("there"), "grounded").when(F.col("close"), "contradiction").otherwise("unsupported")
    return rows.join(there, [key, "no"], "left").select(key, "no", verdict.alias("verdict"))


def check(drafts: DataFrame, sources: DataFrame, listed: DataFrame, dictionary: DataFrame | Sequence[str], key: str, text: str = "text", failed: DataFrame | None = None) -> DataFrame:
    """Claims of drafts with their verdicts; sources (key, source, text), listed (key, url, status).

    failed: documents (key) one of whose sources couldn't be read: what nothing supports there can't be verified, but
    for addresses.
    """
    found = kept(claims(drafts, key, text, dictionary), "claims")
    numbers, dates = source_facts(sources, key, "source", text)
    parts = [number_verdicts(found, numbers, key), date_verdicts(found, dates, key), url_verdicts(found, listed, key), name_verdicts(found, sources, key, text, dictionary)]
    verdicts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    rows = found.join(verdicts, [key, "no"])
    if failed is not None:
        rows = rows.join(failed.select(key).distinct().withColumn("_failed", F.lit(True)), key, "left")
        rows = rows.withColumn("verdict", F.when(F.col("_failed") & (F.col("verdict") == "unsupported") & (F.col("kind") != "url"), "unverifiable").otherwise(F.col("verdict"))).drop("_failed")
    return rows.withColumn("print", F.substring(F.sha1(F.concat_ws(":", "kind", "claim")), 1, 10))
