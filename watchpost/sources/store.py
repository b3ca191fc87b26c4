"""Parquet tables by region and JSON exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema: str, region: str | None = None) -> DataFrame:
    """The table, or its region's part; a missing table is an empty one with the schema."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df if region is None else df.where(df["region"] == region)


def write_table(df: DataFrame, path: str) -> None:
    """Replaces the regions that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
