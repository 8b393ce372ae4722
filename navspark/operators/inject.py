"""Counterfactual attacks on clean tracks: receiver capture plus drift or replay.

Reported speed and course stay untouched. Columns derived from positions become
stale and have to be computed again from the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from navspark.functions.geo import displaced, metres_to_lat, metres_to_lon
from navspark.operators.neighbours import with_span

KINDS = ("drift", "replay")


def unit_normal(seed: int, parts: list[Column], axis: str) -> Column:
    """Standard normal draw that depends only on the row's identity (Box-Muller on md5 digits).

    A generator advanced row by row would tie the values to the partitioning and
    change them when a task is retried.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts, F.lit(axis)).cast("binary"))
    radius = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 1.0) / 4294967297.0
    turn = F.conv(F.substring(digest, 9, 8), 16, 10).cast("double") / 4294967296.0
    return F.sqrt(F.log(radius) * -2.0) * F.cos(turn * (2.0 * math.pi))


def inject(
    frame: DataFrame,
    by: list[str],
    kind: str = "drift",
    drift_mps: float = 0.5,
    offset_m: float = 50.0,
    bearing_deg: float = 45.0,
    onset_frac: float = 0.5,
    capture_sigma_m: float = 0.5,
    seed: int = 0,
) -> DataFrame:
    """Attack every track of ``frame`` from ``onset_frac`` of its time span on.

    From the onset, receiver 2 reports receiver 1's position of exactly the same
    instant plus noise (where there is one), then both are displaced along
    ``bearing_deg``: steadily growing for ``drift``, constant for ``replay``. Adds
    ``onset_utc`` and ``attacked``.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown attack kind {kind!r}; expected one of {KINDS}")
    t = F.col("utc_time")
    onset = F.col("_t0") + (F.col("_t1") - F.col("_t0")) * F.lit(float(onset_frac))
    timed = with_span(frame, by, "utc_time", F.lit(True)).withColumn("onset_utc", onset).withColumn(
        "attacked", t >= F.col("onset_utc")
    )

    lead = frame.where(F.col("receiver") == 1).select(
        *by, "utc_time", F.col("lat_deg").alias("_lat1"), F.col("lon_deg").alias("_lon1"), F.lit(True).alias("_found")
    )
    both = timed.join(lead, [*by, "utc_time"], "left")
    identity = [*[F.col(c).cast("string") for c in by], F.round(t * 1e6).cast("long").cast("string")]
    taken = (F.col("receiver") == 2) & F.col("attacked") & F.col("_found")
    # As with the course of events it models, a lead without latitude loses the position.
    lat = F.col("_lat1") + metres_to_lat(unit_normal(seed, identity, "lat") * float(capture_sigma_m))
    lon = F.col("_lon1") + metres_to_lon(unit_normal(seed, identity, "lon") * float(capture_sigma_m), F.col("_lat1"))
    captured = both.withColumn("_lat", F.when(taken, lat).otherwise(F.col("lat_deg"))).withColumn(
        "_lon", F.when(taken, lon).otherwise(F.col("lon_deg"))
    )
    metres = (t - F.col("onset_utc")) * float(drift_mps) if kind == "drift" else F.lit(float(offset_m))
    moved_lat, moved_lon = displaced(F.col("_lat"), F.col("_lon"), metres, F.lit(float(bearing_deg)))
    movable = F.col("attacked") & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    return (
        captured.withColumn("lat_deg", F.when(movable, moved_lat).otherwise(F.col("_lat")))
        .withColumn("lon_deg", F.when(movable, moved_lon).otherwise(F.col("_lon")))
        .select(*frame.columns, "onset_utc", "attacked")
    )
