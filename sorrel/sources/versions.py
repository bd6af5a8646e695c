"""Tables that change all at once: data goes to new folders, one rename of a manifest makes it the current version.

    path/data/<commit>/<table>      what a commit has written; no file is ever changed
    path/manifests/0000000007.json  the version: for each table its form, schema and the folders that it consists of

Readers follow the manifest with the highest number, so they see all of a commit or none of it, and a crash between any
two steps leaves the version before it. Two writers that start from the same version want the same name; the file system
gives it to one, and the other gets Conflict. A commit has an id of the caller's: when it is tried again after a failure,
or by a task that doesn't know how the first one ended, it changes nothing. What nobody refers to any more goes with
`vacuum`. A table in parts is dealt by a hash of its keys; a merge reads and writes the parts that its rows fall in.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sorrel.session import kept

#: Ids of so many last commits are kept to tell repeats.
REMEMBERED = 1000
WHOLE = "all"  # the part of a table that isn't dealt


class Conflict(RuntimeError):
    """Another writer has made this version; read again and try again."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, folder = _files(spark, path), _path(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the current one by default; an empty one before the first commit."""
    numbers = _numbers(spark, path)
    number = version if version is not None else (numbers[-1] if numbers else 0)
    if not number:
        return {"version": 0, "commits": [], "tables": {}}
    stream = _files(spark, path).open(_path(spark, f"{path}/manifests/{number:010d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, path: str, table: str, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
    """A table, or some of its parts, as of a version."""
    entry = manifest(spark, path, version)["tables"].get(table)
    if entry is None:
        raise KeyError(table)
    schema = StructType.fromJson(json.loads(entry["schema"]))
    folders = [f"{path}/{f}" for p, own in sorted(entry["parts"].items()) if parts is None or p in parts for f in own]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(entry["form"]).load(folders).select(*schema.fieldNames())


def _write_manifest(spark: SparkSession, name: str, content: dict) -> None:
    out = _files(spark, name).create(_path(spark, name), False)
    try:
        out.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True).encode()))
    finally:
        out.close()


def _publish(spark: SparkSession, source: str, target: str) -> None:
    """One rename that fails if the target is there: the only step that readers see."""
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, source), _path(spark, target), options)
    except Exception as e:
        if _files(spark, target).exists(_path(spark, target)):
            raise Conflict(target) from e
        raise


def commit(spark: SparkSession, path: str, commit_id: str, replace: Mapping[str, DataFrame] | None = None, append: Mapping[str, DataFrame] | None = None, merge: Mapping[str, tuple[DataFrame, Column, Sequence[str]]] | None = None, form: str = "parquet", part_by: str | None = None, base: dict | None = None) -> int:
    """Writes tables as one version and returns its number; with an id that was committed before, that one's.

    replace: tables that take the place of what there was; append: rows that are added to it; merge: rows that take the
    place of the named parts, with the column that tells a row's part. part_by: the column whose values are the parts of
    appended tables, so that `read` can take some alone. base: the manifest that the new rows were made
    from, the current one by default; if another writer has made a version since, nothing changes and Conflict is raised.
    """
    old = manifest(spark, path) if base is None else base
    done = {c["id"]: c["version"] for c in manifest(spark, path)["commits"]}
    if commit_id in done:
        return done[commit_id]
    number = old["version"] + 1
    folder = f"data/{hashlib.sha1(commit_id.encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:12]}"
    tables = {k: dict(v, parts=dict(v["parts"])) for k, v in old["tables"].items()}

    def put(df: DataFrame, name: str, by: Sequence[str]) -> str:
        df.write.format(form).partitionBy(*by).save(f"{path}/{folder}/{name}")
        return f"{folder}/{name}"

    def put_parts(df: DataFrame, name: str, part: Column) -> dict[str, str]:
        """Writes a folder for each part, which keeps all columns of df, and returns the folders by part."""
        written = put(df.withColumn("_part", part), name, ["_part"])
        folders = [f.getPath().getName() for f in _files(spark, path).listStatus(_path(spark, f"{path}/{written}")) if f.isDirectory()]
        return {f.partition("=")[2]: f"{written}/{f}" for f in folders}

    for name, df in (replace or {}).items():
        tables[name] = {"form": form, "schema": df.schema.json(), "parts": {WHOLE: [put(df, name, [])]}}
    for name, df in (append or {}).items():
        entry = tables.setdefault(name, {"form": form, "schema": df.schema.json(), "parts": {}})
        more = put_parts(df, name, F.col(part_by)) if part_by else {WHOLE: put(df, name, [])}
        for p, folder_of in more.items():
            entry["parts"][p] = [*entry["parts"].get(p, []), folder_of]
    for name, (df, part, touched) in (merge or {}).items():
        entry = tables.setdefault(name, {"form": form, "schema": df.schema.json(), "parts": {}})
        there = put_parts(df, name, part)
        for p in touched:
            entry["parts"][p] = [there[p]] if p in there else []
    commits = [*old["commits"], {"id": commit_id, "version": number}][-REMEMBERED:]
    draft = f"{path}/manifests/.{uuid.uuid4().hex}"
    _write_manifest(spark, draft, {"version": number, "commits": commits, "tables": tables})
    _publish(spark, draft, f"{path}/manifests/{number:010d}.json")
    return number


def merged(spark: SparkSession, path: str, table: str, new: DataFrame, keys: Sequence[str], commit_id: str, combine: Callable[[DataFrame | None, DataFrame], tuple[DataFrame, Mapping[str, DataFrame]]], parts: int = 64, touched_also: DataFrame | None = None) -> int:
    """Merges rows into a table in parts: combine(old rows of the touched parts, or None, new rows) gives the parts' rows and tables to append.

    touched_also: keys of further rows whose parts combine changes. The number of parts is that of the first merge.
    """
    before = manifest(spark, path)
    done = {c["id"]: c["version"] for c in before["commits"]}
    if commit_id in done:
        return done[commit_id]
    part = F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(parts)).cast("string")
    new = kept(new, "merge")
    asked = new.select(part.alias("p")) if touched_also is None else new.select(part.alias("p")).unionByName(touched_also.select(part.alias("p")))
    touched = sorted(r["p"] for r in asked.distinct().collect())  # at most `parts`
    old = read(spark, path, table, before["version"], touched) if table in before["tables"] else None
    rows, logs = combine(old, new)
    return commit(spark, path, commit_id, append=logs, merge={table: (rows, part, touched)}, base=before)


def upsert(spark: SparkSession, path: str, table: str, new: DataFrame, keys: Sequence[str], commit_id: str, failed: DataFrame | None = None, parts: int = 64) -> int:
    """Puts new in place of the rows with the same keys and logs what changed, all as one version.

    failed: keys of rows that are deleted before, whether a new row comes for them or not. The log is the table
    `<table>_log`: keys, change (added, replaced, removed), old and new values and the commit's id. It is taken from the
    same joined rows that the table is written from, and a row that stays as it is has no line. keys are unique in new.
    """
    values = [c for c in new.columns if c not in keys]
    if table not in manifest(spark, path)["tables"]:
        failed = None  # nothing is there that could have failed

    def combine(old: DataFrame | None, rows: DataFrame) -> tuple[DataFrame, Mapping[str, DataFrame]]:
        before = rows.where("false") if old is None else old
        gone = (rows.where("false") if failed is None else failed).select(*keys).distinct().withColumn("_failed", F.lit(True))
        left = before.select(*keys, F.struct(*values).alias("old")).join(gone, list(keys), "left")
        both = left.join(rows.select(*keys, F.struct(*values).alias("new")), list(keys), "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old")), "replaced").when(F.col("new").isNull() & F.col("_failed"), "removed")
        joined = kept(both.select(*keys, "old", "new", change.alias("change")), "joined")
        own = joined.where("change IS NULL OR change <> 'removed'").select(*keys, F.coalesce("new", "old").alias("v")).select(*keys, "v.*")
        log = joined.where("change IS NOT NULL").select(*keys, "change", "old", "new", F.lit(commit_id).alias("commit"))
        return own.select(*rows.columns), {f"{table}_log": log}

    return merged(spark, path, table, new, keys, commit_id, combine, parts, failed)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes manifests but for the last `keep`, and data that none of those refers to. No writer may be at work."""
    numbers = _numbers(spark, path)
    stay = {f.split("/")[1] for n in numbers[-keep:] for t in manifest(spark, path, n)["tables"].values() for own in t["parts"].values() for f in own}
    files = _files(spark, path)
    for n in numbers[:-keep]:
        files.delete(_path(spark, f"{path}/manifests/{n:010d}.json"), False)
    data = _path(spark, f"{path}/data")
    for f in files.listStatus(data) if files.exists(data) else []:
        if f.getPath().getName() not in stay:
            files.delete(f.getPath(), True)
