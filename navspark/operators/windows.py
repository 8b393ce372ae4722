"""Sliding windows over device tracks, anchored on receiver 1's first epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.operators.dynamics import MATCH_TOL_S, align_epochs, with_derived, with_pairs
from navspark.operators.features import series_statistics
from navspark.operators.neighbours import with_span
from navspark.operators.ordered import exact_quantiles
from navspark.schema import feature_names, raw_keys, series_keys
from navspark.session import stage

# Fixed value: slack that lets a window end exactly on the last epoch.
END_SLACK_S = 1e-9


def assign_windows(rows: DataFrame, window_s: float, stride_s: float) -> DataFrame:
    """One row per (epoch, window it lies in), half-open ``[start, start + window_s)``.

    ``rows`` carry the track's ``_t0`` and ``_t1``; only windows that end by ``_t1`` exist.
    The candidate range is widened by one on both sides and then tested exactly, so
    rounding in the divisions cannot lose or add a window.
    """
    since = F.col("utc_time") - F.col("_t0")
    last = F.floor((F.col("_t1") + END_SLACK_S - window_s - F.col("_t0")) / stride_s) + 1
    low = F.greatest(F.floor((since - window_s) / stride_s), F.lit(0))
    high = F.least(F.floor(since / stride_s) + 1, last)
    # A sequence with low > high would count downwards.
    spread = rows.where(F.col("_t0").isNotNull() & (low <= high)).withColumn("_k", F.explode(F.sequence(low, high)))
    placed = spread.withColumn("window_start", F.col("_t0") + F.col("_k") * F.lit(float(stride_s)))
    begin = F.col("window_start")
    inside = (F.col("utc_time") >= begin) & (F.col("utc_time") < begin + window_s)
    fits = begin + window_s <= F.col("_t1") + END_SLACK_S
    return placed.where(inside & fits).drop("_t0", "_t1", "_k")


def sliding_windows(
    epochs: DataFrame,
    by: list[str],
    window_s: float = 120.0,
    stride_s: float = 60.0,
    min_epochs: int = 60,
) -> DataFrame:
    """Windows with enough receiver-1 epochs: ``by, window_start, n_epochs``."""
    first = epochs.where(F.col("receiver") == 1).select(*by, "receiver", "utc_time")
    placed = assign_windows(with_span(first, by, "utc_time", F.lit(True)), window_s, stride_s)
    return (
        placed.groupBy(*by, "window_start")
        .agg(F.count(F.lit(1)).alias("n_epochs"))
        .where(F.col("n_epochs") >= min_epochs)
    )


def circular_std_deg(angle: str) -> Column:
    """Circular standard deviation in degrees; NULL below two values."""
    rad = F.radians(F.col(angle))
    sin_mean, cos_mean = F.avg(F.sin(rad)), F.avg(F.cos(rad))
    length = F.least(F.greatest(F.sqrt(sin_mean * sin_mean + cos_mean * cos_mean), F.lit(1e-12)), F.lit(1.0))
    return F.when(F.count(angle) >= 2, F.degrees(F.sqrt(F.log(length) * -2.0)))


def window_features(
    epochs: DataFrame,
    by: list[str] = ["cruise_id"],
    window_s: float = 120.0,
    stride_s: float = 60.0,
    min_epochs: int = 60,
    profile: str = "deployable",
    tol: float = MATCH_TOL_S,
    transit_sog_kn: float = 3.0,
    transit_cog_deg: float = 5.0,
    segment_s: float = 3600.0,
    tags: bool = True,
) -> DataFrame:
    """Feature vector per sliding window, equal to recomputing everything inside it.

    A window is a contiguous slice of each track, so neighbours are found once per
    epoch and only checked against the window afterwards: the previous epoch counts
    if it is not before the start, and the nearest partner inside is the nearer of
    the two around the epoch that lie inside. The track is sorted once instead of
    once per overlapping window, and only numbers are replicated.
    """
    wanted = list(dict.fromkeys([*by, "receiver", "utc_time", "lat_deg", "lon_deg",
                                 "sog_knots", "cog_deg", *raw_keys(profile)]))
    rows = align_epochs(epochs.select(*wanted), by, segment_s, span=True)
    placed = assign_windows(rows, window_s, stride_s)
    begin = F.col("window_start")
    clipped = (
        placed.withColumn("prev", F.when(F.col("prev.utc_time") >= begin, F.col("prev")))
        .withColumn("lo", F.when(F.col("lo.utc_time") >= begin, F.col("lo")))
        .withColumn("hi", F.when(F.col("hi.utc_time") < begin + window_s, F.col("hi")))
    )
    series = series_keys(profile)
    measured = with_pairs(with_derived(clipped).drop("prev"), tol)
    # Only receiver 1 is described; receiver 2 is counted.
    first = F.col("receiver") == 1
    keys = [*by, "window_start"]
    masked = measured.select(*keys, "receiver", *[F.when(first, F.col(c)).alias(c) for c in series])
    extra = [
        F.count_if(first).alias("n_epochs_rx1"),
        F.count_if(~first).alias("n_epochs_rx2"),
    ]
    if tags:
        extra.append(circular_std_deg("cog_deg").alias("cog_circ_std_deg"))
    table = (
        series_statistics(masked, keys, series, extra)
        .where(F.col("n_epochs_rx1") >= min_epochs)
        .withColumn("clock_regularity", F.col("time_delta_std"))
    )
    if not tags:
        return table.select(*keys, *feature_names(profile))
    steady = (F.col("sog_knots_median") >= transit_sog_kn) & (F.col("cog_circ_std_deg") <= transit_cog_deg)
    return (
        table.withColumn("n_epochs_win", F.col("n_epochs_rx1"))
        .withColumn("sog_med_kn", F.col("sog_knots_median"))
        .withColumn("transit_tag", F.coalesce(steady.cast("int"), F.lit(0)))
        .select(
            *keys, *feature_names(profile), "n_epochs_win", "sog_med_kn", "cog_circ_std_deg", "transit_tag"
        )
    )


def pair_baseline(windows: DataFrame, by: list[str], column: str = "inter_rx_distance_m_median") -> DataFrame:
    """Median and median absolute deviation of the pair distance over a track's windows."""
    present = windows.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    # One row per track; once written, its real size tells the optimizer how to join it.
    centre = stage(exact_quantiles(present, by, "_v", {"median": 0.5}), "centre")
    spread = present.join(centre, by).withColumn("_gap", F.abs(F.col("_v") - F.col("median")))
    mad = exact_quantiles(spread, by, "_gap", {"mad": 0.5})
    size = present.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return centre.join(mad, by).join(size, by)
