"""Sessions with the settings that the operators rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", app: str = "sorrel", partitions: int = 8) -> SparkSession:
    """UTC, adaptive execution with skew handling; on a cluster, master and sizes come from spark-submit."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees; a temporary one on a single machine, as in tests. It goes when the process ends.

    Without that setting a cluster has no folder that all its machines share, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sorrel-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes what a run has written when its process ends; after the session's end its owner clears the folder."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended before
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read again, for what is used more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int = 0, each: int = 500_000) -> DataFrame:
    """df in as many partitions as a shuffle has, or as rows ask for with so many in each, which aren't put together again.

    For work in Python on short rows, as a file's row group is one task however many rows it holds; and for joins whose
    rows take many times the memory of their compressed bytes, by which partitions are put together else.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), key)
