"""Great-circle distance and grid-cell helpers (built-in math only)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotline.functions.util import col_of

# Fixed value: mean Earth radius in km used by every distance feature.
EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km between two (lat, lon) degree pairs."""
    p1, p2 = F.radians(col_of(lat1)), F.radians(col_of(lat2))
    dphi = p2 - p1
    dlmb = F.radians(col_of(lon2)) - F.radians(col_of(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def planar_deg_distance(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degree space (used by the nearest-record lookup)."""
    return F.sqrt(
        F.pow(col_of(lat1) - col_of(lat2), 2) + F.pow(col_of(lon1) - col_of(lon2), 2)
    )


def cell_sizes_for_radius(radius_km: float, max_abs_lat: float = 60.0) -> tuple[float, float]:
    """Grid cell size (deg lat, deg lon) so one cell spans at least ``radius_km``.

    With cells at least as wide as the search radius, every point within the
    radius of a target lies in the target's cell or one of its 8 neighbours,
    so a 3x3 cell equi-join is exact. Longitude degrees shrink with latitude;
    the size is chosen for the highest latitude expected (``max_abs_lat``).
    """
    km_per_deg_lat = math.pi * EARTH_RADIUS_KM / 180.0
    dlat = radius_km / km_per_deg_lat
    dlon = radius_km / (km_per_deg_lat * math.cos(math.radians(max_abs_lat)))
    # small safety margin against floating error at cell borders
    return dlat * 1.001, dlon * 1.001
