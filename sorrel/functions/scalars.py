"""Scalar rules as Column functions, all inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers to millions of yen, and to yen, by unit of the source.
TO_MILLION = {"yen": "0.000001", "thousand_yen": "0.001", "million_yen": "1"}


def round_half_up(numerator: Column, denominator: Column) -> Column:
    """Integer nearest to numerator / denominator, halves upwards; exact for integers and decimals."""
    return F.floor((2 * numerator + denominator) / (2 * denominator))


def ratio_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole in percent, halves away from zero; null if either is null or whole isn't positive; never minus zero."""
    scale = 10**digits
    magnitude = round_half_up(F.abs(part) * 100 * scale, whole).cast("double") / scale
    signed = F.when(part < 0, -magnitude).otherwise(magnitude)
    return F.when(whole > 0, F.when(signed == 0, F.lit(0.0)).otherwise(signed))


def change_percent(now: Column, before: Column, digits: int = 1) -> Column:
    """Change against the magnitude of the value before; null if that is null or zero."""
    return F.when(before != 0, F.round((now - before).cast("decimal(30,6)") * 100 / F.abs(before), digits).cast("double"))


def in_hundreds(million: Column) -> Column:
    """Millions as hundreds of millions with one decimal, halves away from zero."""
    return F.round(million.cast("decimal(30,6)") / 100, 1).cast("double")


def strict_decimal(text: Column) -> Column:
    """A decimal from digits with separators and a sign; null for anything else."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain.try_cast("decimal(38,6)"))


def scaled(value: Column, unit: Column, table: dict[str, str] | None = None) -> Column:
    """value times the multiplier of its unit; null for an unknown unit."""
    factor = F.create_map(*(x for k, v in (table or TO_MILLION).items() for x in (F.lit(k), F.lit(v).cast("decimal(12,6)"))))
    return value * factor[unit]


def same_amount(unit: Column, old: Column, new: Column) -> Column:
    """Equal, both null, or less than one apart where the unit is a million yen."""
    close = (unit == "million_yen") & (F.abs(old - new) < 1)
    return old.eqNullSafe(new) | F.coalesce(close, F.lit(False))


def add_business_days(day: Column, n: int) -> Column:
    """The n-th weekday after day; holidays count as weekdays."""
    week = F.weekday(day)  # Monday 0
    back = F.date_sub(day, F.greatest(week - 4, F.lit(0)))  # a weekend counts from its Friday
    at = F.weekday(back)
    total = at + n
    return F.date_add(back, (n + 2 * F.floor(total / 5)).cast("int"))


def period_label(month: Column, kind: Column) -> Column:
    """Year and month, with an H for half years."""
    return F.concat(F.substring(month, 1, 4), F.lit("/"), F.substring(month, 6, 2).cast("int").cast("string"), F.when(kind == "half", F.lit(" H")).otherwise(F.lit("")))


def half_year_end(start: Column) -> Column:
    """The month in which the year that begins at start ends."""
    return F.date_format(F.date_sub(F.add_months(start, 12), 1), "yyyy-MM")


def range_label(start: Column, end: Column) -> Column:
    """A date range without parts that repeat."""
    same_year, same_month = F.year(start) == F.year(end), F.month(start) == F.month(end)
    first = F.date_format(start, "yyyy-MM-dd")
    return F.when(start == end, first).when(same_year & same_month, F.concat(first, F.lit("~"), F.date_format(end, "dd"))).when(same_year, F.concat(first, F.lit("~"), F.date_format(end, "MM-dd"))).otherwise(F.concat(first, F.lit("~"), F.date_format(end, "yyyy-MM-dd")))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no utm parameters."""
    plain = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^([A-Za-z]+://[^/?]*)", 1))
    rest = F.regexp_replace(plain, r"^[A-Za-z]+://[^/?]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    params = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike("^utm_") & (p != ""))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def host_key(url: Column) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1)), r"^www\.", "")


def domain_allowed(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, after dropping case and all but letters and digits."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2))))


#: White space and marks that don't count when texts are compared.
_MARKS = r"[ \t\n\r\f\x0b\u00a0\u3000、。，．,.「」『』（）()・:：;；]"


def plain_letters(text: Column) -> Column:
    """A text without case, white space and marks."""
    return F.regexp_replace(F.lower(text), _MARKS, "")


def letter_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters without case, white space and marks; a shorter text is its own one pair."""
    letters = F.split(plain_letters(text), "")
    n = F.greatest(F.size(letters) - 1, F.lit(1))
    # Neighbours are put side by side first: an expression within a lambda runs again for each element.
    both = F.arrays_zip(F.slice(letters, F.lit(1), n), F.slice(letters, F.lit(2), n))
    return F.array_distinct(F.transform(both, lambda p: F.concat(p["0"], F.coalesce(p["1"], F.lit("")))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def token_score(keys: Column, tokens: Column) -> Column:
    """Sum over tokens of the best match with any key: 3 equal, 2 beginning, 1 inside; -1 if a token has none."""

    def best(token: Column) -> Column:
        return F.array_max(F.transform(keys, lambda k: F.when(k == token, 3).when(k.startswith(token), 2).when(k.contains(token), 1).otherwise(0)))

    scores = F.transform(tokens, best)
    return F.when(F.exists(scores, lambda s: s == 0) | (F.size(tokens) == 0), F.lit(-1)).otherwise(F.aggregate(scores, F.lit(0), lambda a, s: a + s))


def html_text(html: Column) -> Column:
    """Visible text of a page by patterns: no scripts, styles or comments; tags and runs of space become one space."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def fingerprint(kind: Column, text: Column) -> Column:
    """The first ten hex digits of the SHA-1 of kind:text."""
    return F.substring(F.sha1(F.concat(kind, F.lit(":"), text)), 1, 10)


def post_length(text: Column) -> Column:
    """Characters of a post; each link counts as 23."""
    return F.length(F.regexp_replace(text, r"https?://[^\s]+", "x" * 23))


def hits(text: Column, word: Column) -> Column:
    """Places of word in text, without overlaps."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def build_day(default: str, name: str = "BUILD_DATE") -> Column:
    """The day that a build takes for today: an environment's setting, else the given one; never the clock."""
    import datetime
    import os

    return F.lit(datetime.date.fromisoformat(os.environ.get(name) or default))
