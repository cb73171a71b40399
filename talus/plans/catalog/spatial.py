"""Distance joins, rainfall at the nearest station, polygons, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import geo
from talus.operators import polygons, rainfall, spatial
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.fragments import POINTS, d, hav, nearest_views, window_sql

query = CATALOG.query


def points(d_: Domain):
    """Every event as a point dated by the event, or by when it was recorded."""
    return d_.events.select(F.col("id").alias("point_id"), "latitude", "longitude", F.coalesce("event_date", "created_at").alias("as_of"))


@query("a01_rainfall_windows", f"""SELECT p.point_id, n.station_id AS nearest_station_id, round(n.dist, 3) AS nearest_station_distance_km,
    w.* EXCLUDE (point_id) REPLACE (coalesce(rainfall_24h_observation_count, 0) AS rainfall_24h_observation_count,
      coalesce(rainfall_72h_observation_count, 0) AS rainfall_72h_observation_count,
      coalesce(rainfall_7d_observation_count, 0) AS rainfall_7d_observation_count,
      coalesce(rainfall_30d_observation_count, 0) AS rainfall_30d_observation_count,
      coalesce(antecedent_observation_count, 0) AS antecedent_observation_count),
    n.station_key IS NOT NULL AS rainfall_available
    FROM pts p LEFT JOIN near n ON p.point_id = n.point_id
    LEFT JOIN (SELECT point_id, {window_sql()} FROM readings30 GROUP BY point_id) w ON p.point_id = w.point_id""", **nearest_views())
def a01(dom: Domain):
    return rainfall.rainfall_summary(points(dom), dom.rainfall).drop("latitude", "longitude", "as_of")


@query("a02_antecedent_index", f"""SELECT point_id, CAST(round(sum(CASE WHEN observed_date >= as_of - INTERVAL 15 DAY THEN
    CAST(coalesce(rainfall_mm, 0) * pow({d(0.9)}, (epoch(as_of) - epoch(observed_date)) / 86400) AS DECIMAL(20, 10)) END), 2) AS DOUBLE) AS antecedent_rainfall_index
    FROM readings30 GROUP BY point_id""", **nearest_views())
def a02(dom: Domain):
    found = rainfall.rainfall_summary(points(dom), dom.rainfall)
    return found.where("rainfall_available").select("point_id", "antecedent_rainfall_index")


@query("a03_windows_per_location", """SELECT latitude, longitude, as_of,
    round(sum(CASE WHEN observed_date >= as_of - INTERVAL 1 DAY THEN rainfall_mm END), 2) AS rainfall_24h,
    round(sum(CASE WHEN observed_date >= as_of - INTERVAL 7 DAY THEN rainfall_mm END), 2) AS rainfall_7d
    FROM (SELECT *, max(observed_date) OVER (PARTITION BY latitude, longitude) AS as_of FROM rain
          WHERE observed_date IS NOT NULL AND rainfall_mm IS NOT NULL) GROUP BY 1, 2, 3""")
def a03(dom: Domain):
    return rainfall.windows_per_location(dom.rainfall)


def density_sql(hits: str) -> str:
    return f"""SELECT p.point_id, CAST(coalesce(n, 0) AS BIGINT) AS historical_landslide_count,
        round(coalesce(n, 0) / (pi() * 100), 6) AS historical_landslide_density_per_km2
        FROM pts p LEFT JOIN ({hits}) USING (point_id)"""


HITS = f"""SELECT point_id, count(*) AS n FROM pts p JOIN haz e ON e.latitude BETWEEN p.latitude - {d(0.0925)} AND p.latitude + {d(0.0925)}
    AND floor(e.latitude * 10) BETWEEN floor((p.latitude - {d(0.0925)}) * 10) AND floor((p.latitude + {d(0.0925)}) * 10)
    AND e.event_date <= p.as_of AND {hav('p.latitude', 'p.longitude', 'e.latitude', 'e.longitude')} <= 10 GROUP BY point_id"""


@query("a05_event_density", density_sql(HITS), pts=POINTS)
def a05(dom: Domain):
    out = spatial.event_density(points(dom), dom.events)
    return out.select("point_id", "historical_landslide_count", "historical_landslide_density_per_km2")


@query("p18_haversine", f"SELECT site_no, round({hav(d(27.041), d(88.2636), 'latitude', 'longitude')}, 6) AS distance_km FROM stations")
def p18(dom: Domain):
    distance = geo.haversine_km(F.lit(27.041), F.lit(88.2636), F.col("latitude"), F.col("longitude"))
    return dom.stations.select("site_no", F.round(distance, 6).alias("distance_km"))


@query("p19_bounding_box", f"SELECT id, latitude, longitude FROM haz WHERE latitude BETWEEN {d(26.5)} AND {d(27.25)} AND longitude BETWEEN {d(88.4)} AND {d(89.1)}")
def p19(dom: Domain):
    return dom.events.where(geo.within_box(F.col("latitude"), F.col("longitude"), 26.5, 88.4, 27.25, 89.1)).select("id", "latitude", "longitude")


@query("p20_common_filters", """SELECT id, source_id, event_date FROM haz WHERE source_id = 'src_20'
    AND event_date >= TIMESTAMP '1996-01-01' AND event_date <= TIMESTAMP '1999-06-30'""")
def p20(dom: Domain):
    out = spatial.common_filters(dom.events, "event_date", "src_20", "1996-01-01 00:00:00", "1999-06-30 00:00:00")
    return out.select("id", "source_id", "event_date")


@query("p29_degree_box", f"""SELECT id, round(10 / {d(111.32)}, 9) AS half_lat,
    round(10 / ({d(111.32)} * greatest(cos(radians(latitude)), {d(0.01)})), 9) AS half_lon FROM haz""")
def p29(dom: Domain):
    half_lat, half_lon = geo.degree_box(F.col("latitude"), 10.0)
    return dom.events.select("id", F.round(half_lat, 9).alias("half_lat"), F.round(half_lon, 9).alias("half_lon"))


@query("p33_station_key", """SELECT source_record_id, rainfall_mm,
    coalesce(nullif(station_id, ''), round(latitude, 4) || ',' || round(longitude, 4)) AS station_key FROM rain""")
def p33(dom: Domain):
    key = geo.station_key(F.col("station_id"), F.col("latitude"), F.col("longitude"))
    return dom.rainfall.select("source_record_id", "rainfall_mm", key.alias("station_key"))


@query("p34_density_per_area", "SELECT id, round(historical_event_count / (pi() * 100), 6) AS density FROM zones WHERE historical_event_count IS NOT NULL")
def p34(dom: Domain):
    return dom.zones.where("historical_event_count IS NOT NULL").select(
        "id", geo.density_per_km2(F.col("historical_event_count"), 10.0).alias("density"))


@query("j01_nearby_events", f"""SELECT id, latitude, longitude, event_date, round(dist, 3) AS distance_km FROM
    (SELECT *, {hav(d(27.041), d(88.9), 'latitude', 'longitude')} AS dist FROM haz) WHERE dist <= 40
    AND event_date >= TIMESTAMP '1996-01-01' ORDER BY dist, id LIMIT 100""")
def j01(dom: Domain):
    out = spatial.nearby(dom.events, 27.041, 88.9, 40.0, 100, "event_date", ["id"], start="1996-01-01 00:00:00")
    return out.select("id", "latitude", "longitude", "event_date", "distance_km")


@query("j01_nearby_rainfall", f"""SELECT source_record_id, station_id, observed_date, rainfall_mm, round(dist, 3) AS distance_km FROM
    (SELECT *, {hav(d(26.9), d(88.75), 'latitude', 'longitude')} AS dist FROM rain) WHERE dist <= 30
    ORDER BY dist, source_record_id, observed_date, rainfall_mm LIMIT 100""")
def j01r(dom: Domain):
    out = spatial.nearby(dom.rainfall, 26.9, 88.75, 30.0, 100, "observed_date", ["source_record_id", "observed_date", "rainfall_mm"])
    return out.select("source_record_id", "station_id", "observed_date", "rainfall_mm", "distance_km")


@query("j02_radius_join", f"""SELECT id, site_no, round(dist, 3) AS distance_km FROM (SELECT e.id, s.site_no,
    {hav('e.latitude', 'e.longitude', 's.latitude', 's.longitude')} AS dist FROM haz e, stations s) WHERE dist <= 25""")
def j02(dom: Domain):
    pairs = spatial.radius_pairs(dom.events.select("id", "latitude", "longitude"), dom.stations.drop("station_id"), 25.0)
    return pairs.select("id", "site_no", F.round("distance_km", 3).alias("distance_km"))


@query("j02_k_nearest", f"""SELECT id, CAST(rank AS INTEGER) AS rank, site_no, round(dist, 3) AS distance_km FROM (SELECT *,
    row_number() OVER (PARTITION BY id ORDER BY dist, site_no) AS rank FROM (SELECT e.id, s.site_no,
    {hav('e.latitude', 'e.longitude', 's.latitude', 's.longitude')} AS dist FROM haz e, stations s) WHERE dist <= 25) WHERE rank <= 3""")
def j02k(dom: Domain):
    """The three nearest stations of every event."""
    events = dom.events.select(F.col("id").alias("point_id"), "latitude", "longitude")
    found = spatial.k_nearest(events, dom.stations, 3, 25.0, "site_no")
    return found.select(F.col("point_id").alias("id"), "rank", "site_no", F.round("distance_km", 3).alias("distance_km"))


@query("j02_nearest_events", f"""SELECT site_no, CAST(rank AS INTEGER) AS rank, id, round(dist, 3) AS distance_km FROM (SELECT *,
    row_number() OVER (PARTITION BY site_no ORDER BY dist, id) AS rank FROM (SELECT e.id, s.site_no,
    {hav('e.latitude', 'e.longitude', 's.latitude', 's.longitude')} AS dist FROM haz e, stations s) WHERE dist <= 40) WHERE rank <= 20""")
def j02e(dom: Domain):
    """The twenty events nearest to every station: far more events than are compared."""
    sites = dom.stations.select(F.col("site_no").alias("point_id"), "latitude", "longitude")
    found = spatial.k_nearest(sites, dom.events, 20, 40.0)
    return found.select(F.col("point_id").alias("site_no"), "rank", "id", F.round("distance_km", 3).alias("distance_km"))


@query("j03_nearest_station", "SELECT point_id, station_key, station_id, round(dist, 3) AS distance_km FROM near", **nearest_views())
def j03(dom: Domain):
    return rainfall.nearest_station(points(dom), dom.rainfall).withColumn("distance_km", F.round("distance_km", 3))


@query("j04_lookback_readings", """SELECT point_id, station_key, observed_date, sum(coalesce(rainfall_mm, 0)) AS mm,
    count(*) AS n FROM readings30 GROUP BY 1, 2, 3""", **nearest_views())
def j04(dom: Domain):
    pts = points(dom)
    rows = rainfall.lookback_readings(pts, rainfall.nearest_station(pts, dom.rainfall), dom.rainfall)
    return rows.select("point_id", "station_key", "observed_date", "mm", "n")


CONTAINED = {
    "crossings": """SELECT p.id, e.feature, e.name, e.part, e.ring, count(*) % 2 AS odd FROM haz p JOIN edges e
        ON (e.qy > p.latitude) <> (e.py > p.latitude)
        AND p.longitude < (e.px - e.qx) * (p.latitude - e.qy) / (e.py - e.qy) + e.qx GROUP BY 1, 2, 3, 4, 5""",
    "hits": """SELECT id, feature, name FROM (SELECT id, feature, name, part, max(CASE WHEN ring = 0 THEN odd ELSE 0 END) AS o,
        max(CASE WHEN ring > 0 THEN odd ELSE 0 END) AS h FROM crossings GROUP BY 1, 2, 3, 4) WHERE o = 1 AND h = 0""",
    "first_hit": "SELECT id, min(feature) AS feature, arg_min(coalesce(name, ''), feature) AS name FROM hits GROUP BY id",
}


@query("j05_point_in_polygon", "SELECT p.id, h.feature AS region_feature, nullif(h.name, '') AS region FROM haz p LEFT JOIN first_hit h USING (id)", **CONTAINED)
def j05(dom: Domain):
    return polygons.locate(dom.events.select("id", "latitude", "longitude"), dom.polygons).select("id", "region_feature", "region")


@query("j06_fill_places", """SELECT p.id, coalesce(p.state, nullif(h.name, '')) AS state,
    CASE WHEN p.state IS NULL THEN nullif(h.name, '') END AS district FROM haz p LEFT JOIN first_hit h USING (id)""", **CONTAINED)
def j06(dom: Domain):
    out = polygons.fill_places(dom.events.select("id", "latitude", "longitude", "state"), dom.polygons, dom.polygons)
    return out.select("id", "state", "district")


@query("j07_outside_buffer", f"""SELECT id AS point_id FROM (SELECT id, 26 + CAST((id * 6007) % 20000 AS DOUBLE) / 10000 AS y,
    88 + CAST((id * 48611) % 20000 AS DOUBLE) / 10000 AS x FROM zones) z WHERE NOT EXISTS (SELECT 1 FROM haz e
    WHERE e.latitude BETWEEN y - {d(0.03)} AND y + {d(0.03)} AND {hav('y', 'x', 'e.latitude', 'e.longitude')} <= {d(0.7)})""")
def j07(dom: Domain):
    # Zones share their places with events, so the candidates get places of their own.
    place = lambda base, factor: F.lit(base) + F.pmod(F.col("id") * factor, F.lit(20000)).cast("double") / F.lit(10000.0)
    apart = dom.zones.select(F.col("id").alias("point_id"), place(26.0, 6007).alias("latitude"), place(88.0, 48611).alias("longitude"))
    return spatial.outside_buffer(apart, dom.events, 0.7).select("point_id")


@query("j12_known_states", "SELECT id, state FROM haz WHERE state IN (SELECT name FROM rings WHERE name IS NOT NULL)")
def j12(dom: Domain):
    names = dom.polygons.where("name IS NOT NULL").select(F.col("name").alias("state"))
    return dom.events.join(names, "state", "left_semi").select("id", "state")


@query("j15_alerts_with_zone", """SELECT a.id, a.zone_id, z.state, a.severity, a.created_at FROM alerts a JOIN zones z ON a.zone_id = z.id
    WHERE z.state = 'NATION_3' AND a.severity = 'HIGH' AND a.created_at >= TIMESTAMP '1997-01-01'""")
def j15(dom: Domain):
    recent = dom.alerts.where("severity = 'HIGH' AND created_at >= TIMESTAMP_NTZ'1997-01-01'")
    zones = dom.zones.where("state = 'NATION_3'").select(F.col("id").alias("zone_id"), "state")
    return recent.join(zones, "zone_id").select("id", "zone_id", "state", "severity", "created_at")


@query("j16_source_names", "SELECT e.id, coalesce(s.display_name, e.source_id) AS source FROM haz e LEFT JOIN source_names s USING (source_id)")
def j16(dom: Domain):
    return dom.events.join(dom.source_names, "source_id", "left").select("id", F.coalesce("display_name", "source_id").alias("source"))


@query("u01_labelled_points", """SELECT 'event_' || id AS point_id, latitude, longitude, coalesce(event_date, created_at) AS as_of,
    1 AS label, 'external_real' AS source_type FROM haz UNION ALL
    SELECT 'negative_' || id, latitude, longitude, updated_at, 0, 'derived' FROM zones""")
def u01(dom: Domain):
    from talus.operators import features

    negatives = dom.zones.select(F.concat(F.lit("negative_"), F.col("id").cast("string")).alias("point_id"), "latitude", "longitude",
                                 F.col("updated_at").alias("as_of"))
    return features.labelled_points(features.event_points(dom.events), negatives)

