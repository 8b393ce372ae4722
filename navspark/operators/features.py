"""Feature vectors per recording or per window: five statistics per epoch series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.operators.dynamics import MATCH_TOL_S, align_epochs, with_derived, with_pairs
from navspark.schema import feature_names, raw_keys, series_keys


def moment_statistics(key: str) -> list[Column]:
    """Mean, population standard deviation, minimum and maximum; NULLs are left out."""
    return [
        F.expr(f"avg({key}) AS {key}_mean"),
        F.expr(f"stddev_pop({key}) AS {key}_std"),
        F.expr(f"CAST(min({key}) AS DOUBLE) AS {key}_min"),
        F.expr(f"CAST(max({key}) AS DOUBLE) AS {key}_max"),
    ]


def series_statistics(rows: DataFrame, keys: list[str], series: list[str], extra: list[Column]) -> DataFrame:
    """Mean, std, min, max and exact median of every series, per group, in one aggregate.

    The median holds a group's distinct values while it counts. Groups are recordings or
    windows, which their duration bounds whatever the number of rows; for groups that nothing bounds there is
    ``ordered.exact_quantiles``.
    """
    moments = [stat for key in series for stat in moment_statistics(key)]
    medians = [F.expr(f"median({key}) AS {key}_median") for key in series]
    return rows.groupBy(*keys).agg(*moments, *medians, *extra)


def recording_features(
    epochs: DataFrame,
    by: list[str] = ["recording"],
    profile: str = "full",
    tol: float = MATCH_TOL_S,
    segment_s: float = 3600.0,
) -> DataFrame:
    """One feature vector per recording.

    Raw and derived statistics describe receiver 1, or receiver 2 where a recording
    has no receiver-1 epoch. Receivers are summarised apart and the choice is made
    on the summaries, so no detail row needs to know about the other receiver.
    """
    series = series_keys(profile)
    wanted = list(dict.fromkeys([*by, "receiver", "utc_time", "lat_deg", "lon_deg",
                                 "sog_knots", "cog_deg", *raw_keys(profile)]))
    rows = with_pairs(_with_derived_for_pairs(align_epochs(epochs.select(*wanted), by, segment_s)), tol)
    per_receiver = series_statistics(rows, [*by, "receiver"], series, [F.count(F.lit(1)).alias("_n")])
    names = [n for n in feature_names(profile) if n not in ("clock_regularity", "n_epochs_rx1", "n_epochs_rx2")]
    # At most two rows per recording are left. Receiver 2 has no pair statistics of its
    # own, so taking the first receiver's row whole also leaves those NULL.
    chosen = per_receiver.groupBy(*by).agg(
        F.min_by(F.struct(*names), "receiver").alias("_row"),
        *[
            F.coalesce(F.max(F.when(F.col("receiver") == r, F.col("_n"))), F.lit(0)).alias(f"n_epochs_rx{r}")
            for r in (1, 2)
        ],
    )
    summary = chosen.select(*by, "_row.*", "n_epochs_rx1", "n_epochs_rx2")
    return summary.withColumn("clock_regularity", F.col("time_delta_std")).select(*by, *feature_names(profile))


def _with_derived_for_pairs(aligned: DataFrame) -> DataFrame:
    """Derived series added, alignment structs kept for the pairing step."""
    return with_derived(aligned).drop("prev")


def ordered_for_export(features: DataFrame, meta: list[str], tail: list[str] = []) -> DataFrame:
    """Metadata first, then the feature columns by name, then ``tail``."""
    rest = sorted(c for c in features.columns if c not in meta and c not in tail)
    return features.select(*[c for c in meta if c in features.columns], *rest, *[c for c in tail if c in features.columns])
