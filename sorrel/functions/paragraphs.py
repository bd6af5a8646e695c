"""Paragraphs as column expressions: which hold a word, which are kept under a budget, those of printed lines, decoded bytes."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters between which a line break is no space.
CJK = r"[\u3000-\u30ff\u3400-\u9fff\uff00-\uffef]"
#: Printable ASCII in its full width, which lies at a fixed distance.
FULL_WIDTH, DISTANCE = range(0xFF01, 0xFF5F), 0xFEE0


def _half_width(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, FULL_WIDTH)) + "\u3000", "".join(chr(c - DISTANCE) for c in FULL_WIDTH) + " ")


def holds_word(text: Column, words: Sequence[str]) -> Column:
    """Does a text hold any of the words, whatever the case and width: ASCII ones on their boundaries, letters of others with spaces between them or not."""
    forms = []
    for word in words:
        letters = word.lower().split()
        if all(x.isascii() for x in letters):
            forms.append("(?<![a-z0-9])" + r"\s+".join(map(re.escape, letters)) + "(?![a-z0-9])")
        else:
            forms.append(r"\s*".join(re.escape(c) for x in letters for c in x))
    return F.lower(_half_width(text)).rlike("|".join(f for f in forms if f)) if any(forms) else F.lit(False)


def under_budget(df: DataFrame, paragraphs: str, words: Sequence[str], keep: int = 6000, head: int = 1500, least: int = 200) -> DataFrame:
    """df with kept (place from 0 and text of the paragraphs that stay) and missed (does none hold a word) of a column of arrays.

    Those with a word come first and then their neighbours, up to keep characters in all: one with a word that doesn't
    fit is cut if at least `least` characters are left, a neighbour that doesn't fit is left out, and what comes later
    still has its chance. Without a word the text's beginning is kept, head characters of it. Empty paragraphs are none,
    a null array keeps none.
    """
    # A step a projection: an expression within a lambda runs again for each element, a column doesn't.
    rows = df.withColumn("_marked", F.transform(paragraphs, lambda t: holds_word(t, words)))
    rows = rows.withColumn("missed", ~F.exists("_marked", lambda m: m))
    marked, missed = F.col("_marked"), F.col("missed")
    at = lambda i: F.coalesce(F.try_element_at(marked, i + 1), F.lit(False))
    before = lambda i: F.when(i > 0, at(i - 1)).otherwise(F.lit(False))
    # How a paragraph stands: its turn, and from how many characters on it may be cut.
    never = F.lit((1 << 31) - 1)
    ranked = F.transform(F.col(paragraphs), lambda t, i: F.struct(
        F.when(missed, F.lit(0)).when(at(i), F.lit(0)).when(before(i) | at(i + 1), F.lit(1)).alias("turn"),
        F.when(missed | at(i), i).when(before(i), 2 * i - 1).otherwise(2 * i + 2).alias("order"),
        F.when(missed, F.lit(1)).when(at(i), F.lit(least)).otherwise(never).alias("cut"),
        i.alias("place"), t.alias("text"),
    ))
    rows = rows.withColumn("_turns", F.sort_array(F.filter(ranked, lambda x: x["turn"].isNotNull() & (F.length(x["text"]) > 0))))
    none = F.array().cast("array<struct<place: int, text: string>>")
    start = F.struct(F.when(missed, F.lit(head)).otherwise(F.lit(keep)).alias("room"), none.alias("kept"))

    def take(state: Column, x: Column) -> Column:
        n = F.length(x["text"])
        size = F.when(n <= state["room"], n).when(state["room"] >= x["cut"], state["room"]).otherwise(F.lit(0))
        more = F.array_append(state["kept"], F.struct(x["place"].alias("place"), F.substring(x["text"], F.lit(1), size).alias("text")))
        return F.struct((state["room"] - size).alias("room"), F.when(size > 0, more).otherwise(state["kept"]).alias("kept"))

    return rows.withColumn("kept", F.aggregate("_turns", start, take, lambda x: F.sort_array(x["kept"]))).drop("_marked", "_turns")


def printed_paragraphs(text: Column, least: int = 2) -> Column:
    """The paragraphs of a printed page as an array: an empty line or the end of a sentence at a line's end closes one; shorter ones go."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^[ \t\u3000]+|[ \t\u3000]+$", "")
    parts = F.split(F.regexp_replace(lines, r"(?<=[。．！？])\n", "\n\n"), r"\n\n+")
    one_line = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, rf"(?<={CJK})\s+(?={CJK})", ""), r"[\s\u00a0\u3000]+", " "))
    return F.filter(F.transform(parts, one_line), lambda p: F.length(p) >= least)


# Other names of an encoding, and those that are tried when none is named.
ENCODINGS = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932"}
OLD_ENCODINGS = ("cp932", "euc-jp")


@F.pandas_udf(StringType())
def decoded_as(data: pd.Series, encoding: pd.Series) -> pd.Series:
    """The text of bytes in an encoding; null if there is none of that name or it doesn't fit."""

    def one(x: bytes | None, name: str | None) -> str | None:
        try:
            return None if x is None or not name else bytes(x).decode(name)
        except (LookupError, UnicodeDecodeError):
            return None

    return pd.Series([one(x, name) for x, name in zip(data, encoding, strict=True)], dtype=object)


def decoded(data: Column, content_type: Column) -> Column:
    """The text of a page's bytes: in the encoding that its header declares, its own, UTF-8, or an old one that fits; else with marks for what doesn't."""
    same = F.create_map(*(F.lit(x) for pair in ENCODINGS.items() for x in pair))
    named = lambda x: F.coalesce(F.try_element_at(same, F.lower(x)), F.lower(x))
    declared = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([\w-]+)", 1)
    own = F.regexp_extract(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1)
    text = data.cast("string")
    found = [decoded_as(data, named(x)) for x in (declared, own)]
    old = [decoded_as(data, F.lit(x)) for x in OLD_ENCODINGS]
    return F.coalesce(*found, F.when(F.is_valid_utf8(text), text), *old, F.make_valid_utf8(text))
