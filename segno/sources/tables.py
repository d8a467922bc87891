"""The input tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segno.plans import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``.  The package goes to the executors with the first one read."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
