"""Great-circle column expressions (all JVM side)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    dlon = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    east = F.sin(dlon) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The place on the unit sphere: east of the pole's axis, north of it, along it."""
    p, l = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def chord(km: float) -> float:
    """Straight distance, on the unit sphere, of places ``km`` apart."""
    return 2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2))


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Point reached from (lat, lon) along ``bearing`` after ``km``."""
    p, b, a = F.radians(lat), F.radians(bearing), km / F.lit(EARTH_KM)
    p2 = F.asin(F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(
        F.sin(b) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * F.sin(p2)
    )
    return F.degrees(p2), F.degrees(l2)


def angle_gap(a: Column, b: Column) -> Column:
    """Smallest difference of two angles in [0, 360)."""
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def sectors_of(azimuth: Column, width: int = 5) -> Column:
    """Sectors [s, s+width] that contain the azimuth; a boundary belongs to both neighbours."""
    base = (F.floor(azimuth / width) * width).cast("int")
    before = F.pmod(base - width, F.lit(360)).cast("int")
    return F.when(azimuth % width == 0, F.array(base, before)).otherwise(F.array(base))


def box_geojson(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Closed ring of a bounding box as GeoJSON text; ``{}`` when there is no box."""
    ring = F.array(
        F.array(min_lon, min_lat), F.array(max_lon, min_lat), F.array(max_lon, max_lat),
        F.array(min_lon, max_lat), F.array(min_lon, min_lat),
    )
    body = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    return F.when(min_lat.isNull(), F.lit("{}")).otherwise(body)


def cell(lat: Column, lon: Column, deg: float) -> tuple[Column, Column]:
    """Integer grid cell of a coordinate."""
    return F.floor(lat / deg).cast("int"), F.floor(lon / deg).cast("int")
