"""Model replies as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_replies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(url, raw)`` of classification or selector replies; other columns (``order_key``) stay.

    A page without a row has no analysis.
    """
    reader = spark.read
    if fmt == "json":
        reader = reader.schema("url string, raw string, order_key array<bigint>")
    return reader.format(fmt).load(path)
