"""Cleaning, parsing, validation and encoding expressions over text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus import vocab
from talus.functions import quality, text
from talus.operators import features, model
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.fragments import d
from talus.sources import registry

query = CATALOG.query


def _list(c):
    return F.array_join(c, ";")


@query("p01_blank_to_null", """SELECT row_key, CASE WHEN trim("Latitude") <> '' THEN "Latitude" END AS latitude, CASE WHEN trim("Date") <> '' THEN "Date" END AS "date" FROM raw_events""")
def p01(dom: Domain):
    return dom.raw_events.select("row_key", text.blank_to_null(F.col("Latitude")).alias("latitude"), text.blank_to_null(F.col("Date")).alias("date"))


@query("p02_text_to_double", """SELECT row_key, TRY_CAST(nullif(trim("Latitude"), '') AS DOUBLE) AS latitude, TRY_CAST("NDVI" AS DOUBLE) AS ndvi FROM raw_events""")
def p02(dom: Domain):
    return dom.raw_events.select("row_key", text.to_double(F.col("Latitude")).alias("latitude"), text.to_double(F.col("NDVI")).alias("ndvi"))


DATES = """SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.250000' WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y')
    WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 6 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 7 THEN strftime(o_orderdate, '%Y%m%d')
    WHEN 8 THEN strftime(o_orderdate, '%m/%d/%Y') || ' 03:15:00 PM' WHEN 9 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') WHEN 10 THEN 'NaN'
    WHEN 11 THEN strftime(o_orderdate, '%Y') WHEN 12 THEN '' ELSE 'next week' END AS t FROM orders"""


@query("p03_parse_date", """SELECT id, CASE WHEN lower(trim(t)) IN ('', 'nan', 'none', 'null') OR length(t) = 4 THEN NULL ELSE coalesce(
    try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(t, '%Y/%m/%d'),
    try_strptime(t, '%d-%m-%Y'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%Y%m%d'),
    try_strptime(t, '%m/%d/%Y %I:%M:%S %p'), try_strptime(t, '%m/%d/%Y %H:%M:%S')) END AS parsed FROM texts""", texts=DATES)
def p03(dom: Domain):
    k, ts = F.col("o_orderkey"), F.col("o_orderdate")
    fmt = lambda p: F.date_format(ts, p)
    texts = [fmt("yyyy-MM-dd"), fmt("yyyy-MM-dd'T'HH:mm:ss"), F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250000")), fmt("yyyy/MM/dd"),
             fmt("dd-MM-yyyy"), fmt("dd/MM/yyyy"), fmt("MM/dd/yyyy"), fmt("yyyyMMdd"), F.concat(fmt("MM/dd/yyyy"), F.lit(" 03:15:00 PM")),
             fmt("MM/dd/yyyy HH:mm:ss"), F.lit("NaN"), fmt("yyyy"), F.lit(""), F.lit("next week")]
    chosen = F.get(F.array(*texts), F.pmod(k, F.lit(len(texts))).cast("int"))
    return dom.table("orders").select(k.alias("id"), text.parse_date(chosen).alias("parsed"))


COORD = """concat_ws(';', CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinates' END, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat BETWEEN -90 AND 90)
    THEN 'invalid_latitude' END, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT (lon BETWEEN -180 AND 180) THEN 'invalid_longitude' END)"""
NUMBERS = """SELECT row_key, idx, "Date", TRY_CAST(nullif(trim("Latitude"), '') AS DOUBLE) AS lat, TRY_CAST(lng AS DOUBLE) AS lon, TRY_CAST(rain_24h AS DOUBLE) - 3 AS rain,
    TRY_CAST("Humidity" AS DOUBLE) AS hum, TRY_CAST("NDVI" AS DOUBLE) AS veg FROM raw_events"""


@query("p04_coordinate_errors", f"SELECT row_key, {COORD} AS errors FROM nums", nums=NUMBERS)
def p04(dom: Domain):
    lat, lon = text.to_double(F.col("Latitude")), text.to_double(F.col("lng"))
    return dom.raw_events.select("row_key", _list(quality.coordinate_errors(lat, lon)).alias("errors"))


@query("p05_value_errors", """SELECT row_key, concat_ws(';', CASE WHEN rain < 0 THEN 'invalid_rainfall_24h' END, CASE WHEN NOT hum BETWEEN 0 AND 100 THEN 'invalid_humidity' END,
    CASE WHEN NOT veg BETWEEN 0 AND 1 THEN 'invalid_vegetation' END) AS errors FROM nums""", nums=NUMBERS)
def p05(dom: Domain):
    number = lambda c: text.to_double(F.col(c))
    errors = quality.value_errors({"rainfall_24h": number("rain_24h") - 3, "humidity": number("Humidity"), "vegetation": number("NDVI")})
    return dom.raw_events.select("row_key", _list(errors).alias("errors"))


@query("p06_missing_date", """SELECT row_key, CASE WHEN "Date" IS NULL OR trim("Date") = '' THEN 'missing_date' ELSE '' END AS errors FROM raw_events""")
def p06(dom: Domain):
    return dom.raw_events.select("row_key", _list(quality.date_errors(F.col("Date"))).alias("errors"))


@query("p07_vegetation", f"""SELECT row_key, round(greatest(0, least(1, veg)), 4) AS fraction, round(greatest(0, least(1, veg / 100)), 4) AS percent,
    round(greatest(0, least(1, (veg + 1) / 2)), 4) AS ndvi FROM (SELECT row_key, TRY_CAST("NDVI" AS DOUBLE) AS veg FROM raw_events)""")
def p07(dom: Domain):
    v = lambda s: quality.vegetation_fraction(F.col("NDVI"), s)
    return dom.raw_events.select("row_key", v("0-1").alias("fraction"), v("0-100").alias("percent"), v("ndvi").alias("ndvi"))


@query("p08_historical_flag", """SELECT row_key, CASE WHEN event_type = 'O' THEN true WHEN severity IS NULL THEN NULL ELSE severity IN ('yes', '1', 'true') OR severity = 'R' END AS flag,
    CASE WHEN severity IS NULL THEN NULL ELSE false END AS plain FROM raw_events""")
def p08(dom: Domain):
    kind = F.when(F.col("event_type") == "O", "landslide_inventory").otherwise("rainfall")
    said = F.when(F.col("severity") == "R", " YES ").otherwise(F.col("severity"))
    return dom.raw_events.select("row_key", quality.historical_flag(kind, said).alias("flag"), quality.historical_flag(F.lit("rainfall"), F.col("severity")).alias("plain"))


REC_SCORE = """25 * (CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 1 ELSE 0 END) + 25 * (CASE WHEN rain IS NOT NULL OR hum IS NOT NULL THEN 1 ELSE 0 END)
    + 20 * (CASE WHEN veg IS NOT NULL THEN 1 ELSE 0 END) + 20 + 10 * (CASE WHEN trim("Date") <> '' THEN 1 ELSE 0 END)"""
REC_MISSING = """concat_ws(';', CASE WHEN lat IS NULL THEN 'latitude' END, CASE WHEN lon IS NULL THEN 'longitude' END, CASE WHEN rain IS NULL THEN 'rainfall_24h' END,
    'rainfall_7d', CASE WHEN hum IS NULL THEN 'humidity' END, 'temperature', 'slope', 'elevation', CASE WHEN veg IS NULL THEN 'vegetation' END,
    CASE WHEN "Date" IS NULL OR trim("Date") = '' THEN 'event_date' END)"""


@query("p10_record_completeness", f"SELECT row_key, CAST({REC_SCORE} AS INTEGER) AS score, {REC_MISSING} AS missing FROM nums", nums=NUMBERS)
def p10(dom: Domain):
    none = F.lit(None).cast("double")
    number = lambda c: text.to_double(text.blank_to_null(F.col(c)))
    score, missing = quality.record_completeness({
        "latitude": number("Latitude"), "longitude": number("lng"), "rainfall_24h": number("rain_24h"), "rainfall_7d": none, "humidity": number("Humidity"),
        "temperature": none, "slope": none, "elevation": none, "vegetation": number("NDVI"), "historical_landslide": F.lit(True),
        "event_date": text.blank_to_null(F.col("Date"))})
    return dom.raw_events.select("row_key", score.alias("score"), _list(missing).alias("missing"))


@query("p11_event_completeness", """SELECT id, CAST(40 + CASE WHEN event_date IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN event_type IS NOT NULL THEN 15 ELSE 0 END
    + CASE WHEN severity IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN coalesce(state, district) IS NOT NULL THEN 10 ELSE 0 END AS INTEGER) AS score FROM haz""")
def p11(dom: Domain):
    score = quality.event_completeness(F.col("event_date"), F.col("event_type"), F.col("severity"), F.coalesce("state", "district"))
    return dom.events.select("id", score.alias("score"))


@query("p39_source_slug", "SELECT site_no, 'st_' || replace(lower(trim(' Station No ' || site_no || ' ')), ' ', '_') AS slug FROM stations")
def p39(dom: Domain):
    name = F.concat(F.lit(" Station No "), F.col("site_no").cast("string"), F.lit(" "))
    return dom.stations.select("site_no", F.concat(F.lit("st_"), text.source_slug(name)).alias("slug"))


@query("p40_source_summary", "SELECT source_id, name, category, configured, processed FROM sources")
def p40(dom: Domain):
    return registry.public_summary(dom.sources)


@query("p40_source_detail", """SELECT source_id, name, category, configured, processed, regexp_extract(file_path, '[^/]+$') AS local_file_name FROM sources""")
def p40d(dom: Domain):
    return registry.public_detail(dom.sources)


@query("p41_numeric_encoding", """SELECT id, rainfall_24h, rainfall_7d, humidity, temperature, slope, elevation, vegetation,
    CAST(historical_landslide AS INTEGER)::DOUBLE AS historical_landslide, risk_level FROM zones""")
def p41(dom: Domain):
    labelled = dom.zones.withColumn("historical_landslide", F.when(F.col("historical_landslide"), " True ").otherwise("no"))
    return model.risk_rows(labelled.select("id", "risk_level", *vocab.RISK_MODEL_FEATURES))


@query("p44_question_intent", r"""SELECT question_id, CASE WHEN trim(question) = '' THEN 'help'
    WHEN regexp_matches(question, '\b(riskiest|highest.risk|most.risk|which (place|zone|area).{0,20}risk)', 'i') THEN 'riskiest_place'
    WHEN regexp_matches(question, '\b(active alert|how many alert|which places? (have|has) alert)', 'i') THEN 'alerts'
    WHEN regexp_matches(question, '\b(weather|rain|rainfall|temperature|humidity)\b', 'i') THEN 'weather_lookup'
    WHEN regexp_matches(question, '\b(how many|number of).{0,10}(landslide|event)s?.{0,15}\bin\b', 'i') THEN 'state_event_count'
    WHEN regexp_matches(question, '\b(safe|risk in|risk of|tell me about|how risky)\b', 'i') THEN 'place_lookup' ELSE 'unrecognized' END AS intent FROM questions""")
def p44(dom: Domain):
    return dom.questions.select("question_id", text.route_intent(F.col("question")).alias("intent"))


@query("p26_critical_fields", """SELECT id, terrain_data_real AND historical_landslide IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AS complete FROM
    (SELECT *, CASE WHEN id % 11 <> 0 THEN elevation END AS e, CASE WHEN id % 13 <> 0 THEN slope END AS s FROM zones)""")
def p26(dom: Domain):
    row = {name: F.col("rainfall_24h") for name in vocab.CRITICAL_FIELDS}
    row |= {"terrain_available": F.col("terrain_data_real"), "landcover_available": F.lit(True),
            "elevation_m": F.when(F.pmod("id", F.lit(11)) != 0, F.col("elevation")),
            "slope_degrees": F.when(F.pmod("id", F.lit(13)) != 0, F.col("slope"))}
    return dom.zones.select("id", features.complete(row).alias("complete"))


