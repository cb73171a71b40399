"""Boundary files: polygon tables for point-in-polygon, availability and feature counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.polygons import region_name
from talus.sources.files import DatasetError, read_features

_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def _rings(parts):
    """Coordinate arrays to (part, ring, points[x, y]); ring 0 is the outer one, the rest are holes."""
    return F.flatten(
        F.transform(
            parts,
            lambda part, p: F.transform(
                part,
                lambda ring, r: F.struct(
                    p.alias("part"), r.alias("ring"),
                    F.transform(ring, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))).alias("points"),
                ),
            ),
        )
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(feature, name, rings) per Polygon or MultiPolygon. Features are numbered in the order of their files' paths and
    inside those by position, so that no two files share a number."""
    rows = read_features(spark, path)
    per_file = rows.groupBy("file").agg((F.max("at") + 1).alias("n"))
    # One row per boundary file.
    starts = per_file.select("file", F.expr("coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("_start"))
    rows = rows.join(starts, "file")
    parts = F.when(F.col("geometry_type") == "Polygon", F.array(F.from_json("coordinates", _POLYGON))).when(
        F.col("geometry_type") == "MultiPolygon", F.from_json("coordinates", _MULTI)
    )
    named = region_name({f: F.try_element_at("properties", F.lit(f)) for f in _name_fields()})
    return rows.withColumn("parts", parts).where(F.col("parts").isNotNull()).select(
        (F.col("at") + F.col("_start")).cast("long").alias("feature"), named.alias("name"), _rings(F.col("parts")).alias("rings")
    )


def _name_fields():
    from talus.vocab import REGION_NAME_FIELDS

    return REGION_NAME_FIELDS


def status(spark: SparkSession, paths: dict[str, str | None]) -> dict[str, dict[str, bool]]:
    """Per level: is a file configured, and can features be read from it?"""
    out = {}
    for level, path in paths.items():
        available = False
        if path:
            try:
                available = not read_features(spark, path).isEmpty()
            except DatasetError:
                available = False
        out[level] = {"configured": bool(path), "available": available}
    return out


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_features(spark, path).groupBy(F.regexp_extract("file", r"[^/]+$", 0).alias("file_name")).agg(
        F.count("*").alias("features"), F.count_if(F.col("geometry_type").isin("Polygon", "MultiPolygon")).alias("polygons")
    )
