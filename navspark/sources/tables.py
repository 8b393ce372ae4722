"""Manifest, feature tables and detector predictions: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.functions.nmea import number
from navspark.schema import META_COLUMNS

MANIFEST_SCHEMA = "filename string, scenario string, label string, index string, parameters map<string,string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Metadata row per recording; parameters fill slots 1 and 2 in their written order.

    The two slots are all the tables have; a recording with more parameters is an
    error rather than a stray column.
    """
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(path)
    pairs = F.map_entries(F.coalesce("parameters", F.create_map().cast("map<string,string>")))
    slots = raw.withColumn("_pairs", pairs)
    checked = slots.withColumn(
        "_pairs",
        F.when(F.size("_pairs") > 2, F.raise_error(F.concat(F.lit("more than two parameters: "), F.col("filename"))))
        .otherwise(F.col("_pairs")),
    )
    columns = [F.col("filename"), F.col("scenario"), F.col("label"), F.col("index").try_cast("double").cast("int").alias("index")]
    for i in (1, 2):
        pair = F.get("_pairs", F.lit(i - 1))
        columns += [pair["key"].alias(f"param_{i}_name"), number(pair["value"]).alias(f"param_{i}_value")]
    return checked.select(*columns)


def read_feature_table(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Feature rows without extraction errors; every non-metadata column is DOUBLE.

    The schema comes from the header alone, so nothing is scanned to infer types.
    """
    if file_format == "parquet":
        df = spark.read.parquet(path)
    else:
        text = spark.read.option("header", "true").csv(path)
        kinds = {"index": "int", "param_1_value": "double", "param_2_value": "double"}
        as_text = set(META_COLUMNS) - set(kinds) | {"_error"}
        df = text.select(
            *[
                F.col(f"`{c}`") if c in as_text else F.col(f"`{c}`").try_cast(kinds.get(c, "double")).alias(c)
                for c in text.columns
            ]
        )
    if "_error" in df.columns:
        df = df.where(F.coalesce("_error", F.lit("")) == "")
    return df


def read_predictions(spark: SparkSession, path: str, verdict: str) -> DataFrame:
    """``filename, baseline_pred`` of an external detector whose verdict column is ``verdict``."""
    table = spark.read.option("header", "true").csv(path)
    return table.select("filename", F.col(verdict).try_cast("double").alias("baseline_pred"))


def write_report(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One CSV file for a table that is small by construction (models x policies and the like)."""
    out = df.orderBy(*order) if order else df
    out.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_feature_table(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Feature table of any size; as many files as the plan has tasks."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if file_format == "csv" else writer.parquet(path)


def write_epoch_series(frame: DataFrame, path: str, partition: list[str]) -> None:
    frame.write.mode("overwrite").partitionBy(*partition).parquet(path)
