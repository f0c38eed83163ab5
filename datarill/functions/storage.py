"""Cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that the context was given; a local master may do with a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        at = sc._jsc.sc().getCheckpointDir()
        if not at.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="datarill-"))
            at = sc._jsc.sc().getCheckpointDir()
        found = at.get()
    return found.rstrip("/")


def write_shared(df: DataFrame, name: str = "table") -> str:
    """Writes df once and returns its path; Hadoop removes it when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/datarill-{name.replace('@', '-')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def write_counted(df: DataFrame, name: str = "table") -> tuple[str, int]:
    """write_shared() and the number of rows, counted while they are written; a task that ran twice may count twice."""
    seen = Observation()
    path = write_shared(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return path, seen.get["n"]


def write_sized(df: DataFrame, name: str = "table") -> tuple[str, int, list[int]]:
    """write_shared(), the number of rows and about the distinct values of each column, counted while they are written; a task that ran twice may count twice."""
    seen = Observation()
    path = write_shared(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)]), name)
    return path, seen.get["n"], [seen.get[f"d{i}"] for i in range(len(df.columns))]


def read_shared(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths)


def remove_shared(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
