"""Sentences of one second merged into one epoch row per receiver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navspark.functions.nmea import ANCHORS, FIELD_SOURCES
from navspark.operators.neighbours import Lookup, lookup_neighbours

SNR_KEYS = ["mean_snr", "std_snr", "min_snr", "max_snr", "num_sats_with_snr"]


def snr_statistics(value: str = "snr") -> list:
    """Aggregates over one SNR per row; the count is 0 where the others are NULL."""
    v = F.col(value)
    return [
        F.avg(v).alias("mean_snr"),
        F.stddev_pop(v).alias("std_snr"),
        F.min(v).alias("min_snr"),
        F.max(v).alias("max_snr"),
        F.count(v).alias("num_sats_with_snr"),
    ]


def canonical_motion(epochs: DataFrame) -> DataFrame:
    """Speed and course over ground: the RMC value, or the VTG one where RMC has none."""
    return epochs.withColumn("sog_knots", F.coalesce("sog_rmc_knots", "sog_vtg_knots")).withColumn(
        "cog_deg", F.coalesce("cog_rmc_deg", "cog_true")
    )


def attach_to_anchor(sentences: DataFrame, by: list[str], segment: list[str], position: str) -> DataFrame:
    """Give every sentence the time of the latest anchor that arrived before it.

    An anchor is an RMC or GGA with a readable ``epoch_time``; sentences before the
    first one are dropped, and an unreadable anchor leaves the current epoch in place.
    """
    anchor = F.col("source").isin(*ANCHORS) & F.col("anchor_time").isNotNull()
    carried = lookup_neighbours(
        sentences, by, segment, position, [Lookup("_anchor", anchor, ("anchor_time",), "back")]
    )
    usable = ~F.col("fmt").isin(*ANCHORS) | anchor
    return (
        carried.withColumn("utc_time", F.col("_anchor.anchor_time"))
        .where(usable & F.col("utc_time").isNotNull() & F.col("source").isNotNull())
        .drop("_anchor", "anchor_time")
    )


def merge_epochs(sentences: DataFrame, by: list[str], position: str) -> DataFrame:
    """Last writer wins per field, and an empty field of a later sentence does overwrite.

    One partial/final hash aggregate: ``max_by`` ignores rows whose ordering is
    NULL, so the ordering itself says which sentences carry the field.
    """
    rows = sentences.withColumn("snr", F.explode_outer("snrs"))
    fields = [
        F.max_by(F.col(name), F.when(F.col("source").isin(*sources), F.col(position))).alias(name)
        for name, sources in FIELD_SOURCES.items()
    ]
    anchored = F.count_if(F.col("source").isin(*ANCHORS))
    merged = rows.groupBy(*by, "utc_time").agg(
        *fields, *snr_statistics(), anchored.alias("_n_anchor")
    )
    return canonical_motion(merged.where(F.col("_n_anchor") > 0).drop("_n_anchor"))
