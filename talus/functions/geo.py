"""Distances, degree boxes, grid cells and tile/pixel addressing as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus import vocab


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_dlon
    ) * F.sin(half_dlon)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.lit(2 * vocab.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def degree_box(lat: Column, radius_km: Column | float) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of the box that encloses a radius."""
    r = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
    half_lat = r / F.lit(vocab.KM_PER_DEGREE)
    half_lon = r / (F.lit(vocab.KM_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return half_lat, half_lon


# The radius uses the mean earth radius, whose degree is slightly shorter than KM_PER_DEGREE; a
# little slack keeps the pre-filter a superset of the exact test.
BOX_SLACK = 1.02


def circle_box(lat: Column, lon: Column, at_lat: float, at_lon: float, radius_km: float) -> Column:
    """Plain ranges of latitude and longitude that hold every place within the radius, so that files and row groups can be
    skipped. Longitudes lie in [-180, 180]; a box over the date line is two ranges, one over a pole has all longitudes."""
    arc = math.radians(radius_km * BOX_SLACK / vocab.KM_PER_DEGREE)
    out = lat.between(at_lat - math.degrees(arc), at_lat + math.degrees(arc))
    if abs(math.radians(at_lat)) + arc >= math.pi / 2:
        return out
    half = math.degrees(math.asin(min(1.0, math.sin(arc) / math.cos(math.radians(at_lat)))))
    west, east = at_lon - half, at_lon + half
    inside = lon.between(west, east)
    if west < -180:
        inside = inside | (lon >= west + 360)
    if east > 180:
        inside = inside | (lon <= east - 360)
    return out & inside


def within_box(lat: Column, lon: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    if not (min_lat < max_lat and min_lon < max_lon):
        raise ValueError("a box needs min < max in both directions")
    return lat.between(float(min_lat), float(max_lat)) & lon.between(float(min_lon), float(max_lon))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def cells_covering(c: Column, half: Column, size: float) -> Column:
    """Every cell index touched by [c - half, c + half]."""
    return F.sequence(cell(c - half, size), cell(c + half, size))


def cell_size_degrees(radius_km: float) -> float:
    """Grid side for a radius search: one box half-height, so a point covers 3 rows of cells."""
    return radius_km * BOX_SLACK / vocab.KM_PER_DEGREE


def density_per_km2(count: Column, radius_km: float) -> Column:
    return F.round(count / F.lit(math.pi * radius_km * radius_km), 6)


def one_degree_tile(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.floor(lat).cast("int"), F.floor(lon).cast("int")


def three_degree_tile(lat: Column, lon: Column) -> tuple[Column, Column]:
    return (F.floor(lat / 3.0) * 3).cast("int"), (F.floor(lon / 3.0) * 3).cast("int")


def pixel(lat: Column, lon: Column, top: Column, left: Column, res_x: Column, res_y: Column) -> tuple[Column, Column]:
    return (F.floor((top - lat) / res_y).cast("int"), F.floor((lon - left) / res_x).cast("int"))


def station_key(station_id: Column, lat: Column, lon: Column) -> Column:
    place = F.concat_ws(",", F.round(lat, 4).cast("string"), F.round(lon, 4).cast("string"))
    return F.coalesce(F.when(station_id != "", station_id), place)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)
