"""Labelled recordings to a feature table: manifest, captures, epochs, features."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.operators.dynamics import epoch_frame
from navspark.operators.features import ordered_for_export, recording_features
from navspark.schema import META_COLUMNS
from navspark.session import stage
from navspark.sources.pcap import capture_epochs, read_captures, to_uri
from navspark.sources.tables import read_manifest, write_epoch_series, write_feature_table

FAILURES = ("missing", "not a capture file")


def labelled_epochs(
    spark: SparkSession, meta: DataFrame, dataset_dir: str, receivers: dict | None = None, validate_checksums: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Epochs keyed by ``recording`` (the manifest's file name) and the read status per file."""
    prefix = to_uri(os.path.join(dataset_dir, "x"))[:-1]
    packets = read_captures(spark, meta.select(F.concat(F.lit(prefix), "filename").alias("path")))
    epochs, status = capture_epochs(packets, receivers, validate_checksums)
    recording = F.expr(f"substring(path, {len(prefix) + 1})")
    return (
        epochs.withColumn("recording", recording).drop("path"),
        status.withColumn("recording", recording).drop("path"),
    )


def extract_features(
    spark: SparkSession,
    dataset_dir: str,
    out_path: str | None = None,
    profile: str = "full",
    epochs_dir: str | None = None,
    receivers: dict | None = None,
    validate_checksums: bool = False,
    file_format: str = "parquet",
) -> DataFrame:
    """Metadata, features by name, ``n_packets``, ``read_status`` and ``_error`` per recording.

    A recording that cannot be read keeps its row with NULL features and says why in ``_error``. One
    that breaks off keeps the features of what precedes, and only ``read_status`` tells.
    """
    meta = read_manifest(spark, os.path.join(dataset_dir, "dataset.json"))
    epochs, status = labelled_epochs(spark, meta, dataset_dir, receivers, validate_checksums)
    epochs = stage(epochs, "epochs")
    if epochs_dir:
        frame = epoch_frame(epochs, ["recording"])
        labelled = frame.join(meta.select(F.col("filename").alias("recording"), "scenario"), "recording")
        write_epoch_series(labelled, epochs_dir, ["scenario"])
    features = recording_features(epochs, ["recording"], profile)
    table = (
        meta.join(features.withColumnRenamed("recording", "filename"), "filename", "left")
        .join(status.withColumnRenamed("recording", "filename"), "filename", "left")
        .withColumn("_error", F.when(F.col("read_status").isin(*FAILURES), F.col("read_status")).otherwise(""))
    )
    table = ordered_for_export(table, META_COLUMNS, ["n_packets", "read_status", "_error"])
    if not out_path:
        return table
    # The status columns are additions; in the exported table they would pass for features.
    write_feature_table(table.drop("n_packets", "read_status"), out_path, file_format)
    return table


def label_balance(table: DataFrame) -> DataFrame:
    return table.groupBy("label").count()


def error_rows(table: DataFrame, n: int = 10) -> DataFrame:
    return table.where(F.coalesce("_error", F.lit("")) != "").select("filename", "_error").limit(n)
