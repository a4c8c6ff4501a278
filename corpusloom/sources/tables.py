"""Readers of the supplied Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``, a file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
