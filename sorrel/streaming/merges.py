"""A stream merged into a table of latest rows, in parts: a micro-batch rewrites the parts that its keys fall in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sorrel.session import new_folder
from sorrel.sources import versions


def merge_latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, parts: int = 64, keep: int = 2) -> None:
    """Runs the stream over what there is; the table `latest` below path has the row of each key that is last by order, with n, the rows that came for it.

    A micro-batch is a commit with its number as id, so one that runs again after a failure changes nothing, and late rows
    lose to newer ones. The stream goes on from its checkpoint below path; of old versions the last `keep` stay.
    """
    spark = stream.sparkSession
    values = [c for c in stream.columns if c not in keys]

    def combine(old: DataFrame | None, new: DataFrame) -> tuple[DataFrame, Mapping[str, DataFrame]]:
        rows = new if old is None else new.unionByName(old)
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"), F.sum("n").alias("n"))
        return best.select(*keys, "v.*", "n"), {}

    def merge(batch: DataFrame, number: int) -> None:
        versions.merged(spark, path, "latest", batch.withColumn("n", F.lit(1).cast("bigint")), keys, f"batch {number}", combine, parts)
        versions.vacuum(spark, path, keep)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int = 64) -> DataFrame:
    """The table of `merge_latest` in a new folder, read when the stream has come to its end."""
    spark, path = stream.sparkSession, new_folder(stream.sparkSession, "latest")
    merge_latest(stream, keys, order, path, parts)
    if not versions.manifest(spark, path)["version"]:  # no row has come
        return spark.createDataFrame([], StructType([*stream.schema.fields, StructField("n", LongType())]))
    return versions.read(spark, path, "latest")
