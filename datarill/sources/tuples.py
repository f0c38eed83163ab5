"""Tuple files: a header of domains and bits, then one tuple per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datarill.functions.domains import ENUMERATION_LIMIT, DomainTooLarge
from datarill.functions.storage import read_shared, remove_shared, write_counted
from datarill.operators.compile import columns

#: Tuples up to which a tuple file is one part.
ONE_PART = 1_000_000


def bits(size: int) -> int:
    return max(1, (size - 1).bit_length())


def read_tuples(spark: SparkSession, path: str, sizes: list[int | None], limit: int = ENUMERATION_LIMIT) -> DataFrame:
    """Rows of a tuple file. A field is a number, a range ``lo-hi``, or ``*`` for all of its domain; ``#`` and blank lines are skipped."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        raise FileNotFoundError(path)
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    fields = F.split("line", r"\s+")
    df = lines.select(*[F.get(fields, i).alias(c) for i, c in enumerate(columns(len(sizes)))])
    # A header without its mark, or a line that is no tuple, is an error that says so.
    pattern = r"^(\d+|\d+-\d+|\*)$"
    for i, c in enumerate(columns(len(sizes))):
        ok = F.col(c).rlike(pattern)
        text = F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("not a tuple field: "), F.coalesce(F.col(c), F.lit("(missing)")))))
        size = sizes[i]
        if size is None or size > limit:
            full = F.raise_error(F.lit(f"* in column {i} stands for too many values")).cast("long")
        else:
            full = F.lit(size - 1).cast("long")
        low = F.when(text == "*", F.lit(0).cast("long")).otherwise(F.split(text, "-")[0].cast("long"))
        high = F.when(text == "*", full).when(text.contains("-"), F.get(F.split(text, "-"), 1).cast("long")).otherwise(low)
        df = df.withColumn(c, F.explode(F.sequence(low, high)))
    return df.distinct()


def write_tuples(df: DataFrame, path: str, domains: list[tuple[str | None, int | None]], single: bool | None = None) -> None:
    """Writes a folder of text parts: header first, one tuple per line; nothing at all for an empty relation, one line of ``*`` for the whole product.

    ``single`` writes one part in order, as is done by itself up to ONE_PART
    tuples; otherwise each task writes its own part and the header stands in a
    part of its own. The relation is computed once.
    """
    spark = df.sparkSession
    written, total = write_counted(df, "tuples")
    df = read_shared(spark, [written], df.schema)
    if not total:
        spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(path)
        remove_shared(spark, [written])
        return
    single = total <= ONE_PART if single is None else single
    sizes = [s for _, s in domains]
    header = "# " + " ".join(f"{d}{sum(1 for e, _ in domains[:i] if e == d)}:{bits(s) if s else 64}" for i, (d, s) in enumerate(domains))
    if all(sizes):
        product = 1
        for s in sizes:
            product *= s
        if total == product:
            spark.createDataFrame([(header,), (" ".join("*" * len(sizes)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
            remove_shared(spark, [written])
            return
    body = df.select(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(df.columns)])
    order = [f"o{i}" for i in range(len(df.columns))]
    head = spark.createDataFrame([(header,)], "value string")
    if single:
        rows = head.withColumn("_k", F.lit(0)).unionByName(body.withColumn("_k", F.lit(1)), allowMissingColumns=True)
        rows.repartition(1).sortWithinPartitions("_k", *order).select("value").write.mode("overwrite").text(path)
    else:
        head.unionByName(body.select("value")).write.mode("overwrite").text(path)
    remove_shared(spark, [written])


__all__ = ["DomainTooLarge", "bits", "read_tuples", "write_tuples"]
