"""Derived monitoring zones: cluster the events of every known state, one zone per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus import vocab
from talus.operators import cluster, raster


def known_states(events: DataFrame, names: DataFrame) -> DataFrame:
    return events.join(names.where("state IS NOT NULL").select("state"), "state", "left_semi")


def zone_name(state: Column, number: Column, clusters: Column) -> Column:
    numbered = F.concat(state, F.lit(" Region "), number.cast("string"), F.lit(" (Historical Cluster)"))
    return F.when(clusters > 1, numbered).otherwise(F.concat(state, F.lit(" (Historical Cluster)")))


def zones_from_clusters(clustered: DataFrame, dem) -> DataFrame:
    """One unscored zone per cluster: centroid, size, name, terrain where both values exist.

    Terrain is read at the rounded centroid, so the order in which a sum is added up cannot matter.
    """
    groups = cluster.number_clusters(clustered)
    per_state = groups.groupBy("state").agg(F.count("*").alias("clusters"))
    seen = raster.terrain_features(groups, *dem)
    real = F.col("terrain_available") & F.col("slope_degrees").isNotNull() & F.col("elevation_m").isNotNull()
    return seen.join(per_state, "state").select(
        zone_name(F.col("state"), F.col("cluster_no"), F.col("clusters")).alias("name"),
        "state", "latitude", "longitude",
        *[F.lit(0.0).alias(c) for c in ("rainfall_24h", "rainfall_7d", "humidity", "temperature")],
        F.when(real, F.col("slope_degrees")).otherwise(0.0).alias("slope"),
        F.when(real, F.col("elevation_m")).otherwise(0.0).alias("elevation"),
        F.lit(0.5).alias("vegetation"),
        F.lit(True).alias("historical_landslide"),
        F.lit(0.0).alias("risk_score"),
        F.lit("UNKNOWN").alias("risk_level"),
        F.lit("derived").alias("source_type"),
        F.col("event_count").alias("historical_event_count"),
        F.coalesce(real, F.lit(False)).alias("terrain_data_real"),
    )


def build_derived_zones(events: DataFrame, names: DataFrame, dem, eps_km: float = vocab.CLUSTER_EPS_KM,
                        min_samples: int = 1) -> DataFrame:
    """All derived zones; the caller writes them over the previous ones."""
    clustered = cluster.cluster(known_states(events, names), eps_km / vocab.KM_PER_DEGREE, min_samples)
    return zones_from_clusters(clustered, dem)
