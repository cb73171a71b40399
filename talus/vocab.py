"""Vocabularies, aliases, weights, formats and thresholds that results depend on."""

# ---- fixed values: file headers understood for each logical field, first match wins -------------
COLUMN_ALIASES = {
    "location_id": ["location_id", "id", "ID", "site_id", "station_id"],
    "latitude": ["latitude", "lat", "Latitude", "LAT", "Lat", "y"],
    "longitude": ["longitude", "lon", "lng", "Longitude", "LON", "Lng", "x"],
    "date": ["date", "event_date", "Date", "DATE", "timestamp", "event_time"],
    "event_type": ["event_type", "type", "EventType", "landslide_type"],
    "severity": ["severity", "magnitude", "Severity"],
    "rainfall_24h": ["rainfall_24h", "rainfall24h", "rain_24h"],
    "rainfall_7d": ["rainfall_7d", "rainfall7d", "rain_7d"],
    "rainfall": ["rainfall", "precipitation", "rain_mm", "Rainfall"],
    "humidity": ["humidity", "relative_humidity", "Humidity"],
    "temperature": ["temperature", "temp", "Temperature"],
    "elevation": ["elevation", "altitude", "Elevation", "dem"],
    "slope": ["slope", "slope_degrees", "Slope"],
    "vegetation": ["vegetation", "ndvi", "NDVI", "vegetation_index", "land_cover"],
    "historical_landslide": ["historical_landslide", "landslide", "is_landslide"],
}
EVENT_ALIASES = {
    "date": ["eventDate", "EVENT_DATE", "Event_Date"],
    "event_type": ["EVENT_TYPE", "landslide_category"],
    "severity": ["SEVERITY", "fatality_class", "hazard_type", "landslide_size"],
    "source_record_id": ["record_id", "id", "ID", "OBJECTID", "fid", "event_id"],
    "state": ["state", "State", "STATE", "admin_division_name"],
    "district": ["district", "District", "DISTRICT"],
}
RAINFALL_ALIASES = {
    "rainfall": ["rainfall_mm", "RAINFALL", "rain_mm", "precip_mm", "PRCP"],
    "source_record_id": ["record_id"],
    "station_id": ["station_id", "STATION", "Station_ID", "station", "STATION_ID"],
}
REGION_NAME_FIELDS = [
    "name", "NAME", "STATE", "State", "state", "DISTRICT", "District", "district", "NAME_1", "NAME_2",
]

# ---- fixed values: validation ranges (inclusive) ------------------------------------------------
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
VALUE_RANGES = {
    "rainfall_24h": (0.0, None),
    "rainfall_7d": (0.0, None),
    "humidity": (0.0, 100.0),
    "vegetation": (0.0, 1.0),
    "slope": (0.0, 90.0),
    "elevation": (-500.0, 9000.0),
}

# ---- fixed values: completeness weights ---------------------------------------------------------
RECORD_WEIGHTS = {"coordinates": 25, "environmental": 25, "terrain": 20, "historical": 20, "date": 10}
RECORD_FIELD_GROUPS = {
    "coordinates": ["latitude", "longitude"],
    "environmental": ["rainfall_24h", "rainfall_7d", "humidity", "temperature"],
    "terrain": ["slope", "elevation", "vegetation"],
    "historical": ["historical_landslide"],
    "date": ["event_date"],
}
EVENT_WEIGHTS = {"base": 40, "date": 20, "type": 15, "severity": 15, "place": 10}

# ---- fixed values: risk score -------------------------------------------------------------------
RISK_SCALE = {  # input: (saturation value, points at saturation)
    "rainfall_24h": (200.0, 22.0),
    "rainfall_7d": (700.0, 13.0),
    "slope": (60.0, 25.0),
    "vegetation": (1.0, 15.0),
    "historical": (1.0, 15.0),
    "humidity": (100.0, 10.0),
}
FACTORS = ["rainfall", "slope", "vegetation", "historical", "humidity"]
LEVEL_LIMITS = [("LOW", 25.0), ("MODERATE", 50.0), ("HIGH", 75.0)]  # above the last: CRITICAL
RISK_LEVELS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]
LEVEL_SCORES = {"LOW": 12.5, "MODERATE": 37.5, "HIGH": 62.5, "CRITICAL": 87.5}
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MODERATE": 2, "LOW": 3}
ALERT_LEVELS = ["HIGH", "CRITICAL"]
GUARDED_SOURCE = "unavailable_derived_zone_no_real_environment"
RULE_SOURCE = "rule_based_fallback"
MODEL_SOURCE = "machine_learning"
SUSCEPTIBILITY_SOURCE = "susceptibility_ml"
STATIC_ALERT_REASON = "Potential landslide risk detected due to heavy rainfall and steep terrain."

# ---- fixed values: geometry ---------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.32
METERS_PER_DEGREE = 111320.0

# ---- fixed values: rainfall windows -------------------------------------------------------------
WINDOW_DAYS = {"rainfall_24h": 1, "rainfall_72h": 3, "rainfall_7d": 7, "rainfall_30d": 30}
STATION_RADIUS_KM = 25.0
LOOKBACK_DAYS = 30
ANTECEDENT_DAYS = 15
ANTECEDENT_DECAY = 0.9
GRID_LOOKBACK_DAYS = 31

# ---- fixed values: event density ----------------------------------------------------------------
DENSITY_RADIUS_KM = 10.0

# ---- fixed values: terrain and land cover -------------------------------------------------------
SLOPE_BINS = [("<10", 10.0), ("10-20", 20.0), ("20-30", 30.0), ("30-40", 40.0)]  # above: 40+
LANDCOVER_CATEGORIES = ["forest", "grassland", "cropland", "urban", "bare_land", "water", "unknown"]
LANDCOVER_LEGENDS = {
    "esa_worldcover": {
        10: "forest", 20: "grassland", 30: "grassland", 40: "cropland", 50: "urban", 60: "bare_land",
        70: "bare_land", 80: "water", 90: "water", 95: "forest", 100: "bare_land",
    },
}

# ---- fixed values: model features ---------------------------------------------------------------
NUMERIC_FEATURES = [
    "rainfall_24h", "rainfall_72h", "rainfall_7d", "rainfall_30d", "antecedent_rainfall_index",
    "elevation_m", "slope_degrees", "historical_landslide_density_per_km2",
]
DENSITY_FEATURE = "historical_landslide_density_per_km2"
CRITICAL_FIELDS = [
    "rainfall_24h", "rainfall_72h", "rainfall_7d", "rainfall_30d", "antecedent_rainfall_index",
    "elevation_m", "slope_degrees",
]
RISK_MODEL_FEATURES = [
    "rainfall_24h", "rainfall_7d", "humidity", "temperature", "slope", "elevation", "vegetation",
    "historical_landslide",
]

# ---- fixed values: provenance -------------------------------------------------------------------
SOURCE_CATEGORIES = ["historical_landslide", "rainfall", "terrain", "vegetation", "boundary"]

# ---- fixed values: sampling and clustering ------------------------------------------------------
BUFFER_KM = 3.0
NEGATIVES_PER_POSITIVE = 3
ATTEMPTS_PER_SAMPLE = 100
CLUSTER_EPS_KM = 60.0
TIMELINE_STEPS = 60

# ---- fixed values: question routing, first match wins -------------------------------------------
INTENT_PATTERNS = [
    ("riskiest_place", r"\b(riskiest|highest.risk|most.risk|which (place|zone|area).{0,20}risk)"),
    ("alerts", r"\b(active alert|how many alert|which places? (have|has) alert)"),
    ("weather_lookup", r"\b(weather|rain|rainfall|temperature|humidity)\b"),
    ("state_event_count", r"\b(how many|number of).{0,10}(landslide|event)s?.{0,15}\bin\b"),
    ("place_lookup", r"\b(safe|risk in|risk of|tell me about|how risky)\b"),
]

# ---- fixed values: date formats tried in this order after ISO 8601 ------------------------------
# Each entry: (shape of the text, Spark datetime pattern; None = Spark's own timestamp cast).
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", None),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", None),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", None),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} (?i:AM|PM)$", "M/d/yyyy h:m:s a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"),
]
EMPTY_DATE_WORDS = ["nan", "none", "null"]
