"""Windowed aggregates over a stream of files, with what has settled read back as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sorrel.session import new_folder


def read(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, one file or a folder of them, as a stream; its schema comes from the files.

    A stream takes a path for a folder unless it is a pattern, so the last character is put as a class of its own.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def by_window(stream: DataFrame, at: str, size: str, late: str, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """start, keys and measures of tumbling windows; rows later than `late` are dropped once their window has closed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(*(m.alias(k) for k, m in measures.items())).select(F.col("window.start").alias("start"), *keys, *measures)


def staged(df: DataFrame, batch: str, numbers: Sequence[int]) -> DataFrame:
    """A table as a stream that comes in several micro-batches: for each number the rows that have it in the column `batch`.

    Each batch is one folder that is written after those before; a stream takes files in the order of their times, and
    one file a micro-batch. For trying out what depends on batches.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "staged")
    rows = df.persist()
    for number in numbers:
        rows.where(F.col(batch) == number).drop(batch).coalesce(1).write.parquet(f"{folder}/{number:05d}")
    rows.unpersist()
    schema = StructType([f for f in df.schema.fields if f.name != batch])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def settled(stream: DataFrame, keys: Sequence[str], told: dict | None = None) -> DataFrame:
    """Runs a stream over what there is and returns each key's last row.

    Each micro-batch writes the rows that it changed to a folder of its own, so a batch that runs again after a failure
    overwrites what it had written. told gets `batches` with rows and `dropped`, the rows that came after their window.
    """
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if told is not None:
        told["batches"] = sum(p["numInputRows"] > 0 for p in query.recentProgress)
        told["dropped"] = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(folder_of(spark, f"{folder}/out"))
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def folder_of(spark: SparkSession, path: str) -> str:
    """The folder, made if no batch has written to it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return path
