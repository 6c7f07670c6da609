"""Writers: train / test partitions, prediction export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_partitions(df: DataFrame, path: str) -> None:
    """Write a split table partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_partition(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One side of a split; the other side's files are not read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def export_predictions(df: DataFrame, path: str) -> None:
    """Every row as quoted CSV with a header line per file."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
