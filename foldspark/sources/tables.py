"""Reading the star-schema tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; the path may be in any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
