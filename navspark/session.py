"""Session settings the library relies on, and durable staging of intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Exact medians are object aggregates; the default of 128 groups per task
    # would switch them to the sort-based fallback almost immediately.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build_session(app: str = "navspark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _private_dir() -> str:
    return tempfile.mkdtemp(prefix="navspark-")


def staging_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _private_dir()


def run_folder(spark: SparkSession) -> str:
    """Where this application stages its intermediates."""
    return f"{staging_dir(spark).rstrip('/')}/navspark-{spark.sparkContext.applicationId}"


def clear_staging(spark: SparkSession) -> None:
    """Delete what this application has staged, once no result that reads it is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    Used where the same rows feed several branches and must be identical in each
    (for example row positions assigned by a text scan), or where an iterative
    fit would otherwise recompute its input on every pass.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
