"""SQL fragments shared by the checking queries."""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(2 * CAST(6371.0088 AS DOUBLE) * asin(sqrt({a})))"


def d(x: float | int) -> str:
    """A literal as DOUBLE; plain decimals would be exact numerics in the checking engine."""
    return f"CAST({x} AS DOUBLE)"


STATION_KEY = "coalesce(nullif(station_id, ''), round(latitude, 4) || ',' || round(longitude, 4))"

KEYED = f"SELECT *, {STATION_KEY} AS station_key FROM rain WHERE observed_date IS NOT NULL"

POINTS = "SELECT id AS point_id, latitude, longitude, coalesce(event_date, created_at) AS as_of FROM haz"


def nearest_views(points: str = POINTS, radius: float = 25) -> dict[str, str]:
    """pts, obs, near: brute-force nearest station with a reading in the 30 days before as_of."""
    return {
        "pts": points,
        "obs": KEYED,
        "sites": "SELECT DISTINCT station_key, station_id, latitude AS slat, longitude AS slon FROM obs",
        "cand": f"""SELECT * FROM (SELECT p.*, s.*, {hav('latitude', 'longitude', 'slat', 'slon')} AS dist
            FROM pts p, sites s WHERE abs(latitude - slat) < 1) WHERE dist <= {radius}""",
        "near": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, station_key) AS rn
            FROM cand c WHERE EXISTS (SELECT 1 FROM obs o WHERE o.station_key = c.station_key
              AND o.observed_date BETWEEN c.as_of - INTERVAL 30 DAY AND c.as_of)) WHERE rn = 1""",
        "readings30": """SELECT n.point_id, n.station_key, n.as_of, o.observed_date, o.rainfall_mm
            FROM near n JOIN obs o ON o.station_key = n.station_key
             AND o.observed_date BETWEEN n.as_of - INTERVAL 30 DAY AND n.as_of""",
    }


def window_sql() -> str:
    parts = []
    for name, days in (("rainfall_24h", 1), ("rainfall_72h", 3), ("rainfall_7d", 7), ("rainfall_30d", 30)):
        inside = f"observed_date >= as_of - INTERVAL {days} DAY"
        parts.append(f"round(sum(CASE WHEN {inside} THEN coalesce(rainfall_mm, 0) END), 2) AS {name}")
        parts.append(f"count(CASE WHEN {inside} THEN 1 END) AS {name}_observation_count")
    inside = "observed_date >= as_of - INTERVAL 15 DAY"
    decay = "coalesce(rainfall_mm, 0) * pow(CAST(0.9 AS DOUBLE), (epoch(as_of) - epoch(observed_date)) / 86400)"
    parts.append(f"CAST(round(sum(CASE WHEN {inside} THEN CAST({decay} AS DECIMAL(20, 10)) END), 2) AS DOUBLE) AS antecedent_rainfall_index")
    parts.append(f"count(CASE WHEN {inside} THEN 1 END) AS antecedent_observation_count")
    return ", ".join(parts)


RISK = {
    "rain": "round(least(greatest(rainfall_24h, 0), 200) / 200 * 22 + least(greatest(rainfall_7d, 0), 700) / 700 * 13, 2)",
    "slope": "round(least(greatest(slope, 0), 60) / 60 * 25, 2)",
    "vegetation": "round((1 - least(greatest(vegetation, 0), 1)) * 15, 2)",
    "historical": "CASE WHEN historical_landslide THEN CAST(15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "humidity": "round(least(greatest(humidity, 0), 100) / 100 * 10, 2)",
}

GUARD = "(source_type = 'derived' AND NOT terrain_data_real)"


def level(score: str) -> str:
    return (f"CASE WHEN {score} <= 25 THEN 'LOW' WHEN {score} <= 50 THEN 'MODERATE' WHEN {score} <= 75 THEN 'HIGH' "
            f"WHEN {score} IS NOT NULL THEN 'CRITICAL' END")


def detail_view(source: str = "zones") -> str:
    f = RISK
    return (f"SELECT *, {GUARD} AS guarded, {f['rain']} AS f_rainfall, {f['slope']} AS f_slope, {f['vegetation']} AS f_vegetation, "
            f"{f['historical']} AS f_historical, {f['humidity']} AS f_humidity FROM {source}")


def scored_view(source: str = "detail") -> str:
    total = "round(least(f_rainfall + f_slope + f_vegetation + f_historical + f_humidity, 100), 2)"
    return (f"SELECT * EXCLUDE (risk_score, risk_level), CASE WHEN guarded THEN risk_score ELSE {total} END AS risk_score, "
            f"CASE WHEN guarded THEN risk_level ELSE {level(total)} END AS risk_level FROM {source}")


TOP_FACTOR = ("CASE greatest(f_rainfall, f_slope, f_vegetation, f_historical, f_humidity) WHEN f_rainfall THEN 'Rainfall' "
              "WHEN f_slope THEN 'Slope' WHEN f_vegetation THEN 'Vegetation' WHEN f_historical THEN 'Historical' ELSE 'Humidity' END")
