"""Dashboard summaries, pages and ranked lists over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus import vocab
from talus.functions import risk


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("count"))


def events_by_state(events: DataFrame) -> DataFrame:
    return count_by(events, F.coalesce(F.when(F.col("state") != "", F.col("state")), F.lit("Unknown")), "state")


def events_by_source(events: DataFrame, names: DataFrame) -> DataFrame:
    """Counts per source id first; the name lookup then joins one row per source."""
    counts = count_by(events, F.coalesce("source_id", F.lit("unknown")), "source_id")
    return counts.join(names, "source_id", "left").select(F.coalesce("display_name", "source_id").alias("source"), "count")


def events_by_year(events: DataFrame) -> DataFrame:
    return count_by(events.where("event_date IS NOT NULL"), F.year("event_date").cast("string"), "year")


def observations_by_station(observations: DataFrame) -> DataFrame:
    key = F.coalesce(F.when(F.col("station_id") != "", F.col("station_id")), F.lit("Unknown station"))
    return count_by(observations, key, "station")


def event_completeness(events: DataFrame) -> DataFrame:
    """Stored rows and filled fields per source, one pass."""
    fields = ["event_date", "state", "district", "event_type", "severity"]
    return events.groupBy("source_id").agg(
        F.count("*").alias("stored_records"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("with_coordinates"),
        *[F.count(f).alias(f"with_{f}") for f in fields],
    )


def rainfall_completeness(observations: DataFrame) -> DataFrame:
    return observations.groupBy("source_id").agg(
        F.count("*").alias("stored_records"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("with_coordinates"),
        F.count("observed_date").alias("with_observed_date"),
        F.count("station_id").alias("with_station_id"),
        F.count("rainfall_mm").alias("with_rainfall_value"),
    )


def level_distribution(zones: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Zones per level in the fixed level order; the dashboard keeps empty levels, analytics drops them."""
    counts = zones.groupBy("risk_level").agg(F.count("*").alias("count"))
    per_level = counts.groupBy().agg(
        *[F.coalesce(F.max(F.when(F.col("risk_level") == x, F.col("count"))), F.lit(0).cast("long")).alias(x) for x in vocab.RISK_LEVELS]
    )
    rows = per_level.select(F.inline(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("count")) for x in vocab.RISK_LEVELS])))
    return rows if keep_empty else rows.where("count > 0")


def zone_origin(zones: DataFrame) -> DataFrame:
    demo = F.count_if(F.col("source_type") == "demo_seed")
    return zones.agg(demo.alias("reference_zones"), (F.count("*") - demo).alias("real_zones"))


def coverage_summary(regions: DataFrame, zones: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    total = lambda df: df.agg(F.count("*").alias("n")).scalar()
    row = regions.agg(
        F.count("*").alias("monitoring_regions"), F.count_if(F.col("source_type") == "external_real").alias("regions_with_real_data")
    ).select(
        "*", total(zones).alias("total_zones"), total(events).alias("historical_landslide_events"),
        total(sources).alias("registered_data_sources"),
    )
    return row.withColumn("coverage_status", risk.coverage_status(F.col("regions_with_real_data"), F.col("historical_landslide_events")))


def data_status(sources: DataFrame, events: DataFrame, observations: DataFrame, dem: DataFrame, landcover: DataFrame,
                polygons: DataFrame) -> DataFrame:
    total = lambda df: df.agg(F.count("*").alias("n")).scalar()
    some = lambda df: df.limit(1).agg((F.count("*") > 0).alias("x")).scalar()
    return sources.agg(F.count("*").alias("sources_registered"), F.count_if("processed").alias("sources_processed")).select(
        "*", total(events).alias("landslide_events"), total(observations).alias("rainfall_observations"),
        some(dem).alias("dem_available"), some(landcover).alias("landcover_available"), some(polygons).alias("boundaries_available"),
    )


def distinct_states(df: DataFrame) -> DataFrame:
    return df.where("state IS NOT NULL").select("state").distinct().orderBy("state")


def active_alerts(alerts: DataFrame, titles: int = 10) -> DataFrame:
    """How many alerts are active, and the first titles in id order."""
    active = alerts.where("is_active")
    first = active.orderBy("id").limit(titles).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "title", "severity"))),
                                 lambda a: F.concat(a["title"], F.lit(" ("), a["severity"], F.lit(")"))), "\n").alias("lines")
    )
    return active.agg(F.count("*").alias("active")).withColumn("lines", first.scalar())


def timeline(events: DataFrame, steps: int = vocab.TIMELINE_STEPS) -> DataFrame:
    """Dated events in equal time intervals: per-interval and running counts, empty intervals kept."""
    dated = events.where("event_date IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL").select(
        F.floor(F.unix_micros(F.col("event_date").cast("timestamp")) / 1000).cast("long").alias("ms")
    )
    span = dated.agg(
        F.min("ms").alias("first"), F.greatest(F.max("ms") - F.min("ms"), F.lit(1).cast("long")).alias("span"),
        F.least(F.count("*"), F.lit(steps)).cast("long").alias("k"),
    )
    one = span.select(F.struct("first", "span", "k").alias("s")).scalar()
    placed = dated.withColumn("s", one).select(
        F.least(F.col("s.k") - 1, F.floor((F.col("ms") - F.col("s.first")) / F.col("s.span") * F.col("s.k")).cast("long")).alias("step")
    )
    counts = placed.groupBy("step").agg(F.count("*").alias("events"))
    frame = span.where("k > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("step"))
    # At most `steps` rows are left, so the running total may use one task.
    running = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    filled = frame.join(counts, "step", "left").select("step", F.coalesce("events", F.lit(0).cast("long")).alias("events"))
    return filled.withColumn("running_total", F.sum("events").over(running))


def page(df: DataFrame, order: list, page_no: int, page_size: int) -> DataFrame:
    """One page in a total order, with the total row and page counts."""
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)
    return rows.withColumn("total", total).withColumn(
        "total_pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / F.lit(page_size)).cast("long"))
    )


def newest_per_group(df: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """Last rows per group. The rank limit is applied before the shuffle as well (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def sorted_by_risk(zones: DataFrame) -> DataFrame:
    return zones.orderBy(risk.severity_rank(F.col("risk_level")), F.col("risk_score").desc(), "id")


def high_risk(zones: DataFrame) -> DataFrame:
    return sorted_by_risk(zones.where(F.col("risk_level").isin(*vocab.ALERT_LEVELS)))


def riskiest(zones: DataFrame, n: int = 3) -> DataFrame:
    return zones.where(F.col("risk_level") != "UNKNOWN").orderBy(F.col("risk_score").desc(), "id").limit(n)


def alerts_with_status(alerts: DataFrame, status: str = "active") -> DataFrame:
    """active (acknowledged included), acknowledged, resolved or all; newest first."""
    condition = {
        "active": F.col("is_active"), "acknowledged": F.col("status") == "acknowledged",
        "resolved": ~F.col("is_active"), "all": F.lit(True),
    }[status]
    return alerts.where(condition).orderBy(F.col("created_at").desc(), F.col("id").desc())


def visible_zones(zones: DataFrame, alerts: DataFrame, level: str | None = None, state: str | None = None,
                  alerts_only: bool = False, search: str = "") -> DataFrame:
    out = zones
    if level:
        out = out.where(F.col("risk_level") == level)
    if state:
        out = out.where(F.col("state") == state)
    if alerts_only:
        out = out.join(alerts.where("is_active").select(F.col("zone_id").alias("id")), "id", "left_semi")
    text = search.strip().lower()
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "name", "state")), F.lit(text)))
    return out


def first_alert_per_zone(zones: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every zone with its first listed (newest) active alert, if any."""
    best = alerts.where("is_active").groupBy("zone_id").agg(
        F.max_by(F.struct("id", "severity", "created_at"), F.struct("created_at", "id")).alias("a")
    )
    return zones.join(best, zones["id"] == best["zone_id"], "left").select(
        zones["id"], "name", F.col("a.id").alias("alert_id"), F.col("a.severity").alias("alert_severity")
    )


def station_history(observations: DataFrame, station_id: str, limit: int, tie: list[str]) -> DataFrame:
    """One station's readings, oldest first, undated last."""
    return observations.where(F.col("station_id") == station_id).orderBy(F.col("observed_date").asc_nulls_last(), *tie).limit(limit)


def nearest_station_history(pairs: DataFrame, limit: int, tie: list[str]) -> DataFrame:
    """Among rows found around a place (`distance_km` exact), the nearest station's, undated first.

    Without a station id the nearest row's own coordinates identify the station.
    """
    first = pairs.orderBy("distance_km", *tie).limit(1).agg(
        F.first(F.struct("station_id", "latitude", "longitude")).alias("s")
    ).scalar()
    same = F.when(
        F.col("_s.station_id").isNotNull(), F.col("station_id") == F.col("_s.station_id")
    ).otherwise((F.col("latitude") == F.col("_s.latitude")) & (F.col("longitude") == F.col("_s.longitude")))
    return pairs.withColumn("_s", first).where(same).drop("_s").orderBy(F.col("observed_date").asc_nulls_first(), *tie).limit(limit)


def weather_series(history: DataFrame, limit: int = 20) -> DataFrame:
    """Chart series per zone, oldest first; the provider's time, else the time of storage."""
    newest = newest_per_group(history, "zone_id", [F.col("created_at").desc(), F.col("id").desc()], limit)
    return newest.withColumn("time", F.coalesce("observed_at", "created_at")).orderBy("zone_id", "created_at", "id")
