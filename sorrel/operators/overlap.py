"""Text overlap: the runs of characters that drafts share with sources, the longest one, and where they stand.

Runs shorter than `least` don't matter. A window of `least` letters is a hit if it stands on both sides; consecutive hits
of a text are one fragment. Any shared run lies within one fragment of the draft and one of the source, so after one scan
of the sources for the drafts' windows nothing but fragments goes on, and equal fragments, such as a licence line that
most texts hold, are one row whatever their number. Fragments that are equal on both sides are settled; the others meet by
their windows on a diagonal (the difference of places), where consecutive windows are islands whose length is a run's.

The drafts' windows are sent to all tasks if they are WINDOWS at most. Beyond that, sources give a gram of about half a
run for each half a run, which is joined with the drafts' grams; sources that match move once each, and their windows
near a matching gram are joined with the drafts'. Whole texts never move with a pair. Fragments are compared as texts, not
as hashes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.session import kept

#: Windows of drafts that are sent to all tasks at most, 8 bytes each.
WINDOWS = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Width, citation marks such as [S1] and white space ignored."""
    return "".join(re.sub(r"\[S[0-9]+\]", "", unicodedata.normalize("NFKC", text)).split())


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` letters from each place on, built up by doubling."""
    if len(x) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        part, width, power = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, _BASE
        out, done = np.zeros(len(x), np.uint64), 0
        while True:
            if size & width:
                out = part[: len(part)] if not done else out[: len(x) - done - width + 1] * power + part[done : done + len(x) - done - width + 1]
                done += width
            if done == size:
                return out[: len(x) - size + 1]
            part = part[:-width] * power + part[width:]
            width, power = width * 2, power * power


def common_places(a: str, b: str, size: int) -> np.ndarray:
    """Places in a whose next `size` letters stand in b."""
    x, y = windows(letters(a), size), windows(letters(b), size)
    values, first = np.unique(y, return_index=True)
    if not len(values):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    hits = np.flatnonzero(values[at] == x)
    return np.array([i for i in hits.tolist() if a[i : i + size] == b[(j := int(first[at[i]])) : j + size]], np.int64)


def longest_common(a: str, b: str, least: int = 1) -> int:
    """Length of the longest common substring, 0 if it is shorter than least."""
    low, high = least - 1, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if len(common_places(a, b, mid)) else (low, mid - 1)
    return low if low >= least else 0


def matching_spans(a: str, b: str, least: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a that stand in b in runs of `least` letters or more; runs that touch are one."""
    at = common_places(a, b, least)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > least)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + least).tolist(), strict=True))


def _arrow(df: DataFrame, work, schema: str, form=plain) -> DataFrame:
    """mapInArrow for work(key, text in its plain form) -> list of rows; the key is any column, the text the second."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = work(key, form(text or ""), *rest)
                rows += new
                size += sum(len(x) for r in new for x in r if isinstance(x, str)) + len(new)
                if size > 1 << 20:
                    yield _batch(rows, arrow)
                    rows, size = [], 0
            yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _cut(text: str, hits: np.ndarray, least: int) -> list[tuple[int, str]]:
    """(start, text) of the fragments that consecutive hits make."""
    if not len(hits):
        return []
    ends = np.flatnonzero(np.diff(hits) > 1)
    return [(a, text[a : b + least]) for a, b in zip(hits[np.append(0, ends + 1)].tolist(), hits[np.append(ends, len(hits) - 1)].tolist(), strict=True)]


def _fragments(df: DataFrame, key: str, known: DataFrame, least: int) -> DataFrame:
    """key, start, text of the fragments of df (key, text) whose windows' hashes are all in known (h, one row each)."""
    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, start int, text string"
    n = known.count()
    if n <= WINDOWS:
        hashes = np.sort(np.array(known.toArrow().column(0)).view(np.uint64))  # at most WINDOWS numbers
        sent = df.sparkSession.sparkContext.broadcast(hashes)

        def scan(key_, text: str) -> list[tuple]:
            own = windows(letters(text), least)
            if not len(own) or not len(sent.value):
                return []
            at = np.minimum(np.searchsorted(sent.value, own), len(sent.value) - 1)
            return [(key_, a, t) for a, t in _cut(text, np.flatnonzero(sent.value[at] == own), least)]

        return _arrow(df.select(key, "text"), scan, schema)
    marked = _arrow(df.select(key, "text"), lambda k, t: [(k, h, i) for i, h in enumerate(windows(letters(t), least).view(np.int64).tolist())], f"{key} {kind}, h long, at int")
    rows = marked.join(known, "h", "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("at")).alias("at")).join(df.select(key, "text"), key)
    return _arrow(rows.select(key, "text", "at"), lambda k, t, at: [(k, a, x) for a, x in _cut(t, np.array(at, np.int64), least)], schema)


def _near(sources: DataFrame, drafts: DataFrame, source: str, least: int) -> DataFrame:
    """source, h and at of the sources' windows that lie about a gram that the drafts hold, for drafts of any size."""
    kind = dict(sources.dtypes)[source]
    size = (least + 1) // 2
    step = least - size + 1
    grams = _arrow(drafts.select(F.lit(0), "text"), lambda _, t: [(h,) for h in np.unique(windows(letters(t), size)).view(np.int64).tolist()], "h long").distinct()
    own = _arrow(sources.select(source, "text"), lambda k, t: [(k, h, i * step) for i, h in enumerate(windows(letters(t), size)[::step].view(np.int64).tolist())], f"{source} {kind}, h long, at int")
    met = own.join(grams, "h", "left_semi").groupBy(source).agg(F.collect_list("at").alias("at")).join(sources.select(source, "text"), source)

    def about(key, text: str, at: list[int]) -> list[tuple]:
        h = windows(letters(text), least).view(np.int64)
        places = np.unique(np.concatenate([np.arange(max(0, a + size - least), min(len(h), a + 1)) for a in at]))
        return [(key, int(h[i]), int(i), text[i : i + least]) for i in places.tolist()]

    return _arrow(met.select(source, "text", "at"), about, f"{source} {kind}, h long, at int, letters string")


def _source_fragments(drafts: DataFrame, sources: DataFrame, source: str, known: DataFrame, least: int) -> DataFrame:
    """source, start, text of the sources' fragments: by one scan, or by grams where the drafts have too many windows."""
    if known.count() <= WINDOWS:
        return _fragments(sources, source, known, least)
    return _rebuilt(_near(sources, drafts, source, least).join(known, "h", "left_semi").drop("h").distinct(), source)


def _rebuilt(hits: DataFrame, key: str) -> DataFrame:
    """key, start, text of the fragments that windows (key, at, letters) make: the first letters of each and the last one whole."""
    run = F.col("at") - F.row_number().over(Window.partitionBy(key).orderBy("at"))  # one text's hits
    part = hits.withColumn("_run", run).groupBy(key, "_run").agg(F.min("at").alias("start"), F.max_by("letters", "at").alias("_last"), F.sort_array(F.collect_list(F.struct("at", F.substring("letters", 1, 1).alias("c")))).alias("_c"))
    return part.select(key, "start", F.concat(F.array_join(F.transform("_c", lambda x: x["c"]), ""), F.expr("substring(_last, 2)")).alias("text"))


def _hashes(df: DataFrame, least: int, form=plain) -> DataFrame:
    """The distinct hashes of all windows of a column text."""
    return _arrow(df.select(F.lit(0), "text"), lambda _, t: [(h,) for h in np.unique(windows(letters(t), least)).view(np.int64).tolist()], "h long", form).distinct()


def _as_texts(parts: DataFrame, key: str, own: DataFrame, least: int) -> DataFrame:
    """key, start, text of those parts of fragments whose windows stand in own letter by letter: what a hash took for equal goes."""
    cut = lambda df, c: _arrow(df.select(F.col("text").alias("whole"), "text"), lambda k, t: [(k, i, t[i : i + least]) for i in range(len(t) - least + 1)], f"{c} string, at int, letters string", str)
    held = cut(own.select("text").distinct(), "text").select("letters").distinct()
    found = _rebuilt(cut(parts.select("text").distinct(), "whole").join(held, "letters", "left_semi"), "whole")
    return parts.withColumnRenamed("text", "whole").withColumnRenamed("start", "_first").join(found, "whole").select(key, (F.col("_first") + F.col("start")).alias("start"), "text")


def fragments(drafts: DataFrame, sources: DataFrame, draft: str, source: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(draft, start, text) and (source, start, text) of both sides' fragments, each a written table."""
    known = kept(_hashes(drafts, least), "windows")
    own = kept(_source_fragments(drafts, sources, source, known, least), "source-fragments")
    theirs = kept(_hashes(own.select("text").distinct(), least, str), "source-windows")
    return kept(_as_texts(_fragments(drafts, draft, theirs, least), draft, own, least), "draft-fragments"), own


def _runs(x: DataFrame, y: DataFrame, least: int) -> DataFrame:
    """a, b (texts of x and y, one column text each without repeats) and the longest run that they share."""
    same = x.join(y, "text", "left_semi").select(F.col("text").alias("a"), F.col("text").alias("b"), F.length("text").alias("longest"))
    # Windows of both sides meet on diagonals; a text is named by its hash there, so it moves for its own name alone.
    name = lambda df, c: df.select(F.xxhash64("text").alias(c), F.col("text").alias(f"{c}_text"))
    place = lambda df, c, p: _arrow(df.select(F.xxhash64("text").alias(c), "text"), lambda k, t: [(k, i, t[i : i + least]) for i in range(len(t) - least + 1)], f"{c} long, {p} int, w string", str)
    met = place(x, "a", "i").join(place(y, "b", "j"), "w").where("a <> b").select("a", "b", "i", (F.col("i") - F.col("j")).alias("diagonal"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("a", "b", "diagonal").orderBy("i"))
    runs = met.withColumn("_island", island).groupBy("a", "b", "diagonal", "_island").agg((F.count("*") + least - 1).cast("int").alias("n")).groupBy("a", "b").agg(F.max("n").alias("longest"))
    named = runs.join(name(x, "a"), "a").join(name(y, "b"), "b").select(F.col("a_text").alias("a"), F.col("b_text").alias("b"), "longest")
    return same.unionByName(named)


def shared_runs(drafts: DataFrame, sources: DataFrame, draft: str, source: str, least: int = 30) -> DataFrame:
    """(draft, source, longest) of all pairs that share a run of `least` characters; both sides have a column text."""
    x, y = fragments(drafts, sources, draft, source, least)
    runs = _runs(x.select("text").distinct(), y.select("text").distinct(), least)
    pairs = x.select(draft, F.col("text").alias("a")).distinct().join(runs, "a").join(y.select(source, F.col("text").alias("b")).distinct(), "b")
    return pairs.groupBy(draft, source).agg(F.max("longest").alias("longest"))


def longest_runs(drafts: DataFrame, sources: DataFrame, draft: str, source: str, least: int = 30) -> DataFrame:
    """For each draft its longest shared run over all sources (0 if under least) and whether it fails (is there one).

    A fragment that a source has whole is as long as its runs can be; only the others meet the sources' fragments.
    """
    x, y = fragments(drafts, sources, draft, source, least)
    own, theirs = x.select("text").distinct(), y.select("text").distinct()
    whole = own.join(theirs, "text", "left_semi").select("text", F.length("text").alias("longest"))
    rest = own.join(theirs, "text", "left_anti")
    runs = _runs(rest, theirs, least).groupBy(F.col("a").alias("text")).agg(F.max("longest").alias("longest"))
    best = x.select(draft, "text").join(whole.unionByName(runs), "text").groupBy(draft).agg(F.max("longest").alias("longest"))
    return drafts.select(draft).join(best, draft, "left").select(draft, F.coalesce("longest", F.lit(0)).alias("longest"), F.col("longest").isNotNull().alias("failed"))


def shared_spans(drafts: DataFrame, sources: DataFrame, draft: str, source: str, least: int = 30) -> DataFrame:
    """(draft, start, end, text) of the parts of each draft, in its plain form, that sources have; parts that touch are one."""
    x, _ = fragments(drafts, sources, draft, source, least)
    parts = x.select(draft, "start", (F.col("start") + F.length("text")).alias("end"), "text").distinct()
    by = Window.partitionBy(draft).orderBy("start")  # one draft's fragments
    reach = F.lag("end").over(by)  # a later fragment starts and ends later
    marked = parts.withColumn("_reach", reach).withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).cast("int")).withColumn("_part", F.sum("_new").over(by))
    tail = F.when(F.col("_new") == 1, F.col("text")).otherwise(F.expr("substring(text, _reach - start + 1)"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", tail.alias("tail")))), lambda t: t["tail"]), "")
    return marked.groupBy(draft, "_part").agg(F.min("start").alias("start"), F.max("end").cast("int").alias("end"), joined.alias("text")).drop("_part")
