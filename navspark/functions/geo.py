"""Great-circle geometry on latitude/longitude columns (degrees)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
EARTH_RADIUS_M = 6371000.0
MPS_TO_KNOTS = 1.94384
KNOTS_TO_MPS = 0.514444
M_PER_DEG_LAT = 111320.0
MIN_COS_LAT = 1e-6


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Distance in metres; NULL when any coordinate is NULL."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2.0)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.atan2(F.sqrt(chord), F.sqrt(1.0 - chord)) * (2.0 * EARTH_RADIUS_M)


def bearing_deg(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Initial great-circle bearing from a to b; 0 for a zero-length step."""
    phi_a, phi_b = F.radians(lat_a), F.radians(lat_b)
    dlon = F.radians(lon_b - lon_a)
    east = F.sin(dlon) * F.cos(phi_b)
    north = F.cos(phi_a) * F.sin(phi_b) - F.sin(phi_a) * F.cos(phi_b) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def angular_diff_deg(a: Column, b: Column) -> Column:
    """Smallest absolute angle between two directions.

    ``least`` skips NULLs, but both of its arguments are NULL together here.
    """
    gap = F.abs(a - b) % 360.0
    return F.least(gap, 360.0 - gap)


def metres_to_lat(metres: Column) -> Column:
    return metres / M_PER_DEG_LAT


def metres_to_lon(metres: Column, lat: Column) -> Column:
    """East displacement in degrees of longitude at a latitude; NULL latitude gives NULL."""
    scale = F.when(lat.isNotNull(), F.greatest(F.cos(F.radians(lat)), F.lit(MIN_COS_LAT)))
    return metres / (scale * M_PER_DEG_LAT)


def displaced(lat: Column, lon: Column, metres: Column, bearing: Column) -> tuple[Column, Column]:
    """Flat-earth displacement by ``metres`` along ``bearing`` degrees."""
    course = F.radians(bearing)
    return (
        lat + metres_to_lat(metres * F.cos(course)),
        lon + metres_to_lon(metres * F.sin(course), lat),
    )
