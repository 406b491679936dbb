"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``, a file or a folder of part files; only the columns used are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
