"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``: one parquet file or a directory of them, read lazily with pruning and pushdown."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
