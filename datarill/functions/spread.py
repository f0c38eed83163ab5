"""Dealing rows over tasks before they become many more."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns over several tasks a core: few bytes that become many rows, which AQE would leave to one task."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by)
