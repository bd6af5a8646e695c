"""Order by a language's rules, blanks last, and the headings of Japanese readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last letter of each row of the hiragana, small and voiced letters included; fixed values.
KANA_ROWS = [("あ", "ぁ", "お"), ("か", "か", "ご"), ("さ", "さ", "ぞ"), ("た", "た", "ど"), ("な", "な", "の"), ("は", "は", "ぽ"), ("ま", "ま", "も"), ("や", "ゃ", "よ"), ("ら", "ら", "ろ"), ("わ", "ゎ", "ん")]
OTHER = "その他"
#: Katakana lie at a fixed distance from their hiragana.
KATAKANA, DISTANCE = range(0x30A1, 0x30F5), 0x60


def collated(name: Column, language: str = "ja") -> Column:
    """A text that sorts, groups and compares by the rules of a language (ICU)."""
    return F.collate(name, language)


def blanks_last(value: Column, falling: bool = False, language: str | None = None) -> list[Column]:
    """An order in which null, and a text without letters but space, is last in both directions."""
    own = value if language is None else F.when(F.trim(value) != "", value)
    own = own if language is None else collated(own, language)
    return [own.desc_nulls_last() if falling else own.asc_nulls_last()]


def reading_heading(reading: Column) -> Column:
    """The row of the kana that a reading begins with (あ行), its Latin letter in upper case, or the rest."""
    first = F.translate(F.substring(reading, 1, 1), "".join(map(chr, KATAKANA)), "".join(chr(c - DISTANCE) for c in KATAKANA))
    code = F.ascii(first)
    heading = F.when(first.rlike("^[A-Za-z]"), F.upper(first))
    for name, low, high in KANA_ROWS:
        heading = heading.when(code.between(ord(low), ord(high)), f"{name}行")
    return heading.otherwise(OTHER)


def heading_place(heading: Column, letters: Sequence[str] = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) -> Column:
    """The fixed order of headings: rows of the kana, letters, the rest."""
    names = [*(f"{n}行" for n, *_ in KANA_ROWS), *letters, OTHER]
    return F.array_position(F.array(*map(F.lit, names)), heading)
