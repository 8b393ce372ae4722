"""Consecutive-epoch kinematics and receiver-to-receiver comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.functions.geo import (
    KNOTS_TO_MPS,
    MPS_TO_KNOTS,
    angular_diff_deg,
    bearing_deg,
    haversine_m,
    metres_to_lat,
    metres_to_lon,
)
from navspark.operators.asof import pick_nearest
from navspark.operators.neighbours import Lookup, lookup_neighbours
from navspark.schema import DERIVED_KEYS, PAIR_KEYS

# Fixed values.
MATCH_TOL_S = 0.5
MIDNIGHT_JUMP_S = -80000.0
DAY_S = 86400.0

_MOTION = ("lat_deg", "lon_deg", "sog_knots", "cog_deg")


def align_epochs(
    epochs: DataFrame, by: list[str], segment_s: float = 3600.0, span: bool = False
) -> DataFrame:
    """Add ``prev`` (own previous epoch) and, on receiver 1, ``lo``/``hi``.

    ``lo`` and ``hi`` are the receiver-2 epochs just before and just after. All
    three come from the same pass, so dynamics and pairing share one shuffle.
    Nothing here depends on a window or a tolerance, so sliding windows can reuse
    the result: inside ``[start, start + W)`` the previous epoch is ``prev`` if it is
    not earlier than ``start``, and the nearest partner is one of ``lo``/``hi``. ``span``
    adds receiver 1's first and last time as ``_t0``/``_t1``.
    """
    rows = epochs.withColumn("_segment", F.floor(F.col("utc_time") / segment_s))
    first, second = F.col("receiver") == 1, F.col("receiver") == 2
    own = ("lat_deg", "lon_deg", "cog_deg")
    found = lookup_neighbours(
        rows,
        by,
        ["_segment"],
        "utc_time",
        [
            Lookup("_prev1", first, own, "back_strict"),
            Lookup("_prev2", second, own, "back_strict"),
            Lookup("lo", second, _MOTION, "back"),
            Lookup("hi", second, _MOTION, "ahead"),
        ],
        span=first if span else None,
    )
    return (
        found.withColumn("prev", F.when(first, F.col("_prev1")).otherwise(F.col("_prev2")))
        .withColumn("lo", F.when(first, F.col("lo")))
        .withColumn("hi", F.when(first, F.col("hi")))
        .drop("_segment", "_prev1", "_prev2")
    )


def derived_columns(prev: str = "prev") -> dict[str, Column]:
    """Kinematics between ``prev`` and the current epoch; NULL where there is no ``prev``."""
    lat, lon, sog, cog = (F.col(c) for c in _MOTION)
    p_lat, p_lon, p_cog = F.col(f"{prev}.lat_deg"), F.col(f"{prev}.lon_deg"), F.col(f"{prev}.cog_deg")
    raw_dt = F.col("utc_time") - F.col(f"{prev}.utc_time")
    dt = F.when(raw_dt < MIDNIGHT_JUMP_S, raw_dt + DAY_S).otherwise(raw_dt)
    jump = haversine_m(p_lat, p_lon, lat, lon)
    speed = F.when(dt > 0, jump / dt * MPS_TO_KNOTS)
    return {
        "position_jump_m": jump,
        "computed_sog_knots": speed,
        "sog_discrepancy": F.abs(sog - speed),
        "cog_change_rate": F.when(dt > 0, angular_diff_deg(cog, p_cog) / dt),
        "cog_heading_discrepancy": F.when(
            dt > 0, angular_diff_deg(cog, bearing_deg(p_lat, p_lon, lat, lon))
        ),
        "time_delta": dt,
    }


def with_derived(aligned: DataFrame, prev: str = "prev") -> DataFrame:
    columns = derived_columns(prev)
    kept = [c for c in aligned.columns if c not in columns]
    return aligned.select(*kept, *[columns[k].alias(k) for k in DERIVED_KEYS])


def with_pairs(
    aligned: DataFrame,
    tol: float = MATCH_TOL_S,
    lo: str = "lo",
    hi: str = "hi",
) -> DataFrame:
    """Compare receiver 1 with its nearest receiver-2 epoch, moved to the same instant.

    Receivers sample at different phases. The partner is dead-reckoned with its own
    speed and course over the time difference, latitude first, and the new latitude
    scales the longitude step. Without a usable velocity it stays where it is.
    """
    matched = aligned.withColumn("_mate", pick_nearest(F.col("utc_time"), lo, hi, "utc_time", tol, "later"))
    m_lat, m_lon, m_sog, m_cog = (F.col(f"_mate.{c}") for c in _MOTION)
    dt = F.col("utc_time") - F.col("_mate.utc_time")
    metres = m_sog * KNOTS_TO_MPS * dt
    movable = (
        (dt != 0.0) & m_sog.isNotNull() & m_cog.isNotNull() & m_lat.isNotNull() & m_lon.isNotNull()
    )
    course = F.radians(m_cog)
    placed = matched.withColumn(
        "_mate_lat", F.when(movable, m_lat + metres_to_lat(metres * F.cos(course))).otherwise(m_lat)
    )
    new_lat = F.col("_mate_lat")
    placed = placed.withColumn(
        "_mate_lon", F.when(movable, m_lon + metres_to_lon(metres * F.sin(course), new_lat)).otherwise(m_lon)
    )
    values = {
        "inter_rx_distance_m": haversine_m(F.col("lat_deg"), F.col("lon_deg"), new_lat, F.col("_mate_lon")),
        "inter_rx_sog_diff": F.abs(F.col("sog_knots") - m_sog),
        "inter_rx_cog_diff": angular_diff_deg(F.col("cog_deg"), m_cog),
    }
    kept = [c for c in placed.columns if not c.startswith("_mate") and c not in values]
    return placed.select(*kept, *[values[k].alias(k) for k in PAIR_KEYS])


def epoch_frame(epochs: DataFrame, by: list[str], segment_s: float = 3600.0) -> DataFrame:
    """Tidy per-epoch series of both receivers with each receiver's own dynamics."""
    aligned = align_epochs(epochs, by, segment_s)
    return with_derived(aligned).drop("prev", "lo", "hi")
