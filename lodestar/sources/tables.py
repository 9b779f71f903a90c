"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Read ``base/name.parquet``; with ``columns`` only those reach the scan."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df
