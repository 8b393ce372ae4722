"""Helpers shared by the text operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.session import stage

#: A word is a run of anything but these separators.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def small(df: DataFrame, name: str, limit: int = 500_000) -> DataFrame:
    """``df``, written, and sent to every task in joins if it has at most ``limit`` rows; beyond that it is joined by a shuffle."""
    written = stage(df, name)
    return F.broadcast(written) if written.count() <= limit else written


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand rows to Python by the thousand at most, from now on: texts are long, and batches of ten thousand fill memory beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def crc_fold(key: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of a key written as text."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, name: str) -> DataFrame:
    """Number the rows of each key from 0 without ever ordering a whole key in one task.

    ``spread`` is an integer bucket computed from the row. Rows are numbered within
    (key, bucket); the buckets' counts, one small row each, give the offsets.
    """
    df = df.withColumn("_bucket", spread)
    parts = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*parts).agg(F.count("*").alias("_count")).select(
        *[F.col(k).alias(f"_of_{k}") for k in parts], F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset")
    )
    condition = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in parts))
    joined = df.join(offsets, condition).select(*df.columns, "_offset")
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1
    return joined.withColumn(name, (F.col("_offset") + place).cast("long")).drop("_bucket", "_offset")
