"""Real vessel logs to windows, baseline statistics and a divergence audit."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.operators.audit import ks_two_sample
from navspark.operators.ordered import melt
from navspark.operators.windows import pair_baseline, window_features
from navspark.schema import family_of
from navspark.session import stage
from navspark.sources.r2r import read_pair
from navspark.sources.tables import write_epoch_series, write_feature_table, write_report
from navspark.sources.textlog import interleaved_epochs, read_devices

def log_windows(
    spark: SparkSession,
    real_dir: str,
    out_path: str | None = None,
    window_s: float = 120.0,
    stride_s: float = 60.0,
    min_epochs: int = 60,
    profile: str = "deployable",
    validate_checksums: bool = True,
    file_format: str = "parquet",
) -> DataFrame:
    """Windows of every cruise under ``real_dir/<cruise>/rx1|rx2``, all in one job."""
    epochs = interleaved_epochs(read_devices(spark, real_dir), ["cruise_id", "receiver"], validate_checksums)
    epochs = stage(epochs, "epochs")
    windows = window_features(epochs, ["cruise_id"], window_s, stride_s, min_epochs, profile, tags=False)
    if out_path:
        write_feature_table(windows, out_path, file_format)
    return windows


def prepare_cruise(
    spark: SparkSession,
    cruise_id: str,
    rx1_dir: str,
    rx2_dir: str | None = None,
    out_dir: str | None = None,
    window_s: float = 120.0,
    stride_s: float = 60.0,
    min_epochs: int = 100,
    transit_sog_kn: float = 3.0,
    transit_cog_deg: float = 5.0,
    validate_checksums: bool = True,
    labelled: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Windows, epochs, device statistics, pair baseline and (with ``labelled``) KS audit."""
    epochs, stats = read_pair(spark, cruise_id, rx1_dir, rx2_dir, validate_checksums=validate_checksums)
    windows = stage(
        window_features(
            epochs, ["cruise_id"], window_s, stride_s, min_epochs, "deployable",
            transit_sog_kn=transit_sog_kn, transit_cog_deg=transit_cog_deg,
        ),
        "windows",
    )
    result = {
        "epochs": epochs, "stats": stats, "windows": windows,
        "baseline": pair_baseline(windows, ["cruise_id"]),
    }
    if labelled is not None:
        result["ks_audit"] = divergence_audit(windows, labelled)
    if out_dir:
        _write(result, os.path.join(out_dir, cruise_id), cruise_id)
    return result


def _write(result: dict[str, DataFrame], out: str, cruise_id: str) -> None:
    windows = result["windows"]
    write_feature_table(windows, f"{out}/windows.csv", "csv")
    write_epoch_series(result["epochs"], f"{out}/epochs", ["receiver"])
    if "ks_audit" in result:
        write_report(result["ks_audit"], f"{out}/ks_audit.csv")
    spark = windows.sparkSession
    text = json.dumps(baseline_document(result, cruise_id), indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/baseline.json")


def baseline_document(result: dict[str, DataFrame], cruise_id: str) -> dict:
    """Nested summary of a cruise: window count, device statistics, pair distance."""
    stats = {r["receiver"]: r.asDict() for r in result["stats"].collect()}
    keep = ("lag_s", "attached", "attach_dropped", "n_epochs")
    document = {"cruise_id": cruise_id, "n_windows": result["windows"].count()}
    for rx in (1, 2):
        document[f"rx{rx}_stats"] = {k: stats[rx][k] for k in keep} if rx in stats else {}
    pair = result["baseline"].first()
    if pair is not None:
        document["inter_rx_distance_m"] = {"median": pair["median"], "mad": pair["mad"], "n": pair["n"]}
    return document


def divergence_audit(windows: DataFrame, labelled: DataFrame, top: int | None = None) -> DataFrame:
    """KS per shared feature between real windows and the labelled clean class, widest first."""
    shared = [
        c for c in windows.columns
        if c in labelled.columns and family_of(c) not in ("snr", "gsa") and c not in ("cruise_id", "label")
    ]
    real = melt(windows, [], shared).withColumn("is_first", F.lit(True))
    clean = melt(labelled.where(F.col("label") == "unspoofed"), [], shared).withColumn("is_first", F.lit(False))
    table = ks_two_sample(real.unionByName(clean)).select(
        "feature", "ks_stat", F.col("first_median").alias("real_median"), F.col("second_median").alias("labelled_median")
    )
    ranked = table.orderBy(F.col("ks_stat").desc(), "feature")
    return ranked.limit(top) if top else ranked

