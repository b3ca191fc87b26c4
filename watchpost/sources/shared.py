"""Tables in the storage that driver and executors share: lineage ends there, and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder of a session without shared storage, which only a local master may do without.
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver's JVM ends. Where that setting is missing a local master takes a
    temporary folder; a cluster raises ValueError, since a machine's own folder would lose data there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to storage that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-watchpost-"))
        root = _local[0]
    folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/table"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a new shared folder, read again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A `written` for tables that are needed no longer than the block; what outlives it must be written outside."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
