"""Slope and aspect from a 3x3 block, terrain bins, land-cover legend, model encodings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus import vocab


def horn(block: dict[tuple[int, int], Column], size_x: Column, size_y: Column) -> tuple[Column, Column]:
    """Slope and aspect in degrees by third-order finite differences.

    `block[(dr, dc)]` are the eight neighbours (dr grows southward, dc eastward); cell sizes are in
    metres. Flat ground has a slope of 0 and no aspect.
    """
    east = block[-1, 1] + F.lit(2.0) * block[0, 1] + block[1, 1]
    west = block[-1, -1] + F.lit(2.0) * block[0, -1] + block[1, -1]
    south = block[1, -1] + F.lit(2.0) * block[1, 0] + block[1, 1]
    north = block[-1, -1] + F.lit(2.0) * block[-1, 0] + block[-1, 1]
    gx = (east - west) / (F.lit(8.0) * size_x)
    gy = (south - north) / (F.lit(8.0) * size_y)
    slope = F.round(F.degrees(F.atan2(F.hypot(gx, gy), F.lit(1.0))), 3)
    bearing = F.lit(90.0) - F.degrees(F.atan2(gy, -gx))
    wrapped = F.when(bearing < 0, bearing + 360.0).when(bearing > 360.0, bearing - 360.0).otherwise(bearing)
    aspect = F.when((gx != 0) | (gy != 0), F.round(wrapped, 3))
    return slope, aspect


def cell_metres(res_x: Column, res_y: Column, lat: Column, geographic: Column) -> tuple[Column, Column]:
    per_degree = F.lit(vocab.METERS_PER_DEGREE)
    return (
        F.when(geographic, res_x * (per_degree * F.cos(F.radians(lat)))).otherwise(res_x),
        F.when(geographic, res_y * per_degree).otherwise(res_y),
    )


def slope_bin(slope: Column) -> Column:
    label = F.when(slope.isNull(), "unknown")
    for name, upper in vocab.SLOPE_BINS:
        label = label.when(slope < upper, name)
    return label.otherwise("40+")


def landcover_category(code: Column, scheme: str | None, legends: dict | None = None) -> Column:
    """Category of a raw class code under a named legend; callers may add legends."""
    legend = {**vocab.LANDCOVER_LEGENDS, **(legends or {})}.get(scheme or "")
    if not legend:
        return F.lit("unknown")
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(legend.items())])
    return F.coalesce(F.try_element_at(pairs, code.cast("int")), F.lit("unknown"))


def aspect_parts(aspect: Column) -> tuple[Column, Column]:
    """Sine and cosine of a compass direction; the origin stands for 'no direction'."""
    angle = F.radians(aspect)
    return (
        F.coalesce(F.round(F.sin(angle), 6), F.lit(0.0)),
        F.coalesce(F.round(F.cos(angle), 6), F.lit(0.0)),
    )


def landcover_one_hot(category: Column) -> dict[str, Column]:
    known = F.coalesce(F.when(category != "", category), F.lit("unknown"))
    return {
        f"landcover_{name}": F.when(known == name, 1.0).otherwise(0.0) for name in vocab.LANDCOVER_CATEGORIES
    }
