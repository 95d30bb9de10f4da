"""Geography on the sphere, in degrees and kilometres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def great_circle_dist(lat_s: Column, lat_t: Column, lon_s: Column, lon_t: Column) -> Column:
    """Distance in km by the spherical law of cosines; the cosine is clamped to [-1, 1], an unknown distance is 0."""
    a, b = F.radians(lat_s.cast("double")), F.radians(lat_t.cast("double"))
    turn = F.radians(lon_s.cast("double")) - F.radians(lon_t.cast("double"))
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(turn)
    d = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * EARTH_KM
    return F.coalesce(F.when(~F.isnan(d), d), F.lit(0.0))


def haversine_km(lat_s: Column, lon_s: Column, lat_t: Column, lon_t: Column) -> Column:
    """Distance in km by the haversine formula, which keeps its precision for near points. NULL if any part is."""
    a, b = F.radians(lat_s.cast("double")), F.radians(lat_t.cast("double"))
    half_lat, half_lon = (a - b) / 2, F.radians(lon_s.cast("double") - lon_t.cast("double")) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_KM)


def wrap_lon(lon: Column) -> Column:
    """Longitude brought into [-180, 180); values inside stay as they are, bit by bit."""
    lon = lon.cast("double")
    return F.when((lon >= -180) & (lon < 180), lon).otherwise(lon - F.floor((lon + 180) / 360) * 360)


def usable_position(lat: Column, lon: Column) -> Column:
    """True for a position that can be real: known, finite, |lat| <= 90, not the placeholder (0, 0)."""
    inf = math.inf
    fine = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lon) < inf)
    return F.coalesce(fine & (F.abs(lat) <= 90) & ~((lat == 0) & (lon == 0)), F.lit(False))


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The place on the unit sphere."""
    a, b = F.radians(lat.cast("double")), F.radians(lon.cast("double"))
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)
