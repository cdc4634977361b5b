"""Metrics as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
