"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of ``directory``; columns and filters are pushed to its scan by the planner."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
