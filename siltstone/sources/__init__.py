"""Readers and writers."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
