"""Distances on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0


def half_chord(lat1, lon1, lat2, lon2) -> Column:
    """Squared half chord; grows with the distance and needs no arc sine."""
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlon = F.sin(F.radians(lon2 - lon1) / 2)
    return dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon


def half_chord_limit(radius_m: float) -> float:
    """The squared half chord of a distance; from half the way around the earth on it holds every point."""
    return math.sin(min(radius_m / (2 * EARTH_RADIUS_M), math.pi / 2)) ** 2


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(half_chord(lat1, lon1, lat2, lon2))))


def within(lat, lon, centre_lat: float, centre_lon: float, radius_m: float) -> Column:
    """A box that the scan can use, then the exact test."""
    dlat = math.degrees(radius_m / EARTH_RADIUS_M)
    top = min(89.9, abs(centre_lat) + dlat)
    ratio = math.sin(radius_m / EARTH_RADIUS_M) / max(math.cos(math.radians(top)), 1e-9)
    dlon = math.degrees(math.asin(ratio)) if ratio < 1 else 180.0
    box = lat.between(centre_lat - dlat * 1.000001, centre_lat + dlat * 1.000001) & lon.between(
        centre_lon - dlon * 1.000001, centre_lon + dlon * 1.000001
    )
    exact = half_chord(F.lit(centre_lat), F.lit(centre_lon), lat, lon) <= half_chord_limit(radius_m)
    return box & exact
