"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlight.ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns and filters are pruned by the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
