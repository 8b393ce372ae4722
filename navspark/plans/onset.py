"""Data behind the onset check: kinematic traces of a few recordings per class."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pick_per_class(meta: DataFrame, scenario: str, n: int, order: str = "filename") -> DataFrame:
    """First ``n`` recordings of each label within one scenario."""
    ranked = meta.where(F.col("scenario") == scenario)
    tops = []
    for label in ("spoofed", "unspoofed"):
        # orderBy + limit is a distributed top-n; no class is sorted in one task.
        tops.append(ranked.where(F.col("label") == label).orderBy(order).limit(n))
    return tops[0].unionByName(tops[1])


def receiver_traces(epochs: DataFrame, picks: DataFrame, receiver: int = 1) -> DataFrame:
    """``filename, label, seconds, cog_deg, sog_knots`` of the picked recordings."""
    rows = epochs.where(F.col("receiver") == receiver).withColumnRenamed("recording", "filename")
    chosen = rows.join(picks.select("filename", "label"), "filename")
    start = chosen.groupBy("filename").agg(F.min("utc_time").alias("_start"))
    return chosen.join(start, "filename").select(
        "filename", "label", (F.col("utc_time") - F.col("_start")).alias("seconds"), "cog_deg", "sog_knots"
    )
