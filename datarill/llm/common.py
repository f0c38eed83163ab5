"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every operator here: a run of anything but blank and the five ASCII control blanks (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that the context was given."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        given = sc._jsc.sc().getCheckpointDir()
        if given.isDefined():
            found = given.get()
        elif sc.master.startswith("local"):  # one machine, so any of its folders is shared
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="datarill-"))
            found = sc._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Unlike checkpoint() the rows are computed once. The files survive lost
    executors; Hadoop removes them when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/datarill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Removes what materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/datarill-" in file:
            at = spark._jvm.org.apache.hadoop.fs.Path(file)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(name: str | Column = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


__all__ = ["WORD", "materialize", "remove", "shared_dir", "table", "text_of"]
