"""Ingestion: normalization, duplicates, known keys, summaries, rejects, inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus import vocab
from talus.operators import ingest
from talus.plans import ingestion
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.expressions import COORD, REC_MISSING, REC_SCORE
from talus.plans.catalog.spatial import CONTAINED
from talus.runtime import spread, work_path
from talus.sources import files, sinks

query = CATALOG.query

# Validation pass -------------------------------------------------------------------------------
REC = {
    "nums": """SELECT *, TRY_CAST(nullif(trim("Latitude"), '') AS DOUBLE) AS lat, TRY_CAST(lng AS DOUBLE) AS lon, TRY_CAST(rain_24h AS DOUBLE) AS rain,
        TRY_CAST("Humidity" AS DOUBLE) AS hum, round(greatest(0, least(1, TRY_CAST("NDVI" AS DOUBLE))), 4) AS veg, nullif(trim("Date"), '') AS dt FROM raw_events""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY lat, lon, dt ORDER BY idx) AS nth FROM nums",
    "judged": f"""SELECT *, concat_ws(';', nullif({COORD}, ''), CASE WHEN NOT hum BETWEEN 0 AND 100 THEN 'invalid_humidity' END,
        CASE WHEN nth > 1 AND (lat IS NOT NULL OR lon IS NOT NULL OR dt IS NOT NULL) THEN 'duplicate_record' END) AS errors FROM ranked""",
}


def validated(dom: Domain):
    return ingest.validate_records(ingest.normalize_records(dom.raw_events, "inventory", F.lit(0)))


@query("p09_normalize", """SELECT row_key, 'inventory-' || idx AS location_id, lat AS latitude, lon AS longitude, dt AS event_date, rain AS rainfall_24h,
    CAST(NULL AS DOUBLE) AS rainfall_7d, hum AS humidity, CAST(NULL AS DOUBLE) AS temperature, veg AS vegetation, true AS historical_landslide,
    CAST(NULL AS VARCHAR) AS risk_level, 'external' AS source_type, 'inventory' AS source_name FROM nums""", nums=REC["nums"])
def p09(dom: Domain):
    rows = ingestion.numbered(dom.raw_events)
    out = ingest.normalize_records(rows, "inventory")
    return out.select(F.col("_order.row_key").alias("row_key"), "location_id", "latitude", "longitude", "event_date", "rainfall_24h", "rainfall_7d", "humidity",
                      "temperature", "vegetation", "historical_landslide", "risk_level", "source_type", "source_name")


@query("w01_validation_duplicates", "SELECT idx AS \"index\", errors FROM judged", **REC)
def w01(dom: Domain):
    rows = ingestion.numbered(dom.raw_events)
    order = rows.select("_order", "index")
    out = ingest.validate_records(ingest.normalize_records(rows, "inventory"))
    return out.join(order, "_order").select("index", F.array_join("errors", ";").alias("errors"))


@query("a07_validation_summary", """SELECT count(*) AS total_records, count(*) FILTER (errors = '') AS valid_records, count(*) FILTER (errors <> '') AS invalid_records,
    count(*) FILTER (errors LIKE '%missing_coordinates%') AS missing_coordinates, count(*) FILTER (errors LIKE '%duplicate_record%') AS duplicates FROM judged""", **REC)
def a07(dom: Domain):
    return ingest.validation_summary(validated(dom))


@query("a08_reject_reasons", "SELECT reason, count(*) AS \"rows\" FROM (SELECT unnest(string_split(errors, ';')) AS reason FROM judged WHERE errors <> '') GROUP BY 1", **REC)
def a08(dom: Domain):
    return ingest.reason_counts(validated(dom), "errors")


@query("a20_missing_features", f"""SELECT string_agg(f, ';' ORDER BY f) AS missing FROM (SELECT DISTINCT unnest(string_split(m, ';')) AS f FROM
    (SELECT {REC_MISSING} AS m FROM judged WHERE errors = '') WHERE m <> '')""", **REC)
def a20(dom: Domain):
    ok = ingest.with_completeness(validated(dom).where(F.size("errors") == 0))
    return ok.select(F.explode("missing_features").alias("f")).agg(F.array_join(F.sort_array(F.collect_set("f")), ";").alias("missing"))


@query("z01_processed_records", f"""SELECT 'inventory-' || idx AS location_id, lat AS latitude, lon AS longitude, dt AS event_date, rain AS rainfall_24h, hum AS humidity,
    veg AS vegetation, CAST({REC_SCORE} AS INTEGER) AS data_quality_score, {REC_MISSING} AS missing_features FROM judged WHERE errors = ''""", **REC)
def z01(dom: Domain):
    _, scored = ingestion.validate_inventory(dom.raw_events, "inventory")
    return sinks.record_table(scored).select("location_id", "latitude", "longitude", "event_date", "rainfall_24h", "humidity", "vegetation",
                                             "data_quality_score", "missing_features")


# Ingestion -------------------------------------------------------------------------------------
STORED_SQL = "SELECT CASE WHEN id % 4 = 0 THEN id || '-1' END AS source_record_id, latitude, longitude, event_date FROM haz"
PARSE = """CASE WHEN dt IS NULL THEN NULL ELSE coalesce(try_strptime(dt, '%Y-%m-%d'), try_strptime(dt, '%Y/%m/%d'), try_strptime(dt, '%d/%m/%Y'),
    try_strptime(dt, '%m/%d/%Y'), try_strptime(dt, '%m/%d/%Y %H:%M:%S')) END"""
ING = {
    "stored": STORED_SQL,
    "nums": """SELECT *, CASE WHEN trim("Latitude") <> '' AND TRY_CAST("Latitude" AS DOUBLE) IS NULL THEN NULL ELSE TRY_CAST(nullif(trim("Latitude"), '') AS DOUBLE) END AS lat,
        CASE WHEN trim("Latitude") <> '' AND TRY_CAST("Latitude" AS DOUBLE) IS NULL THEN NULL ELSE TRY_CAST(lng AS DOUBLE) END AS lon, nullif(trim("Date"), '') AS dt FROM raw_events""",
    "parsed": f"SELECT *, {COORD} AS reasons, {PARSE} AS event_date FROM nums",
    "usable": "SELECT *, round(lat, 6) AS klat, round(lon, 6) AS klon FROM parsed WHERE reasons = ''",
    "ranked": """SELECT *, CASE WHEN record_id IS NOT NULL THEN row_number() OVER (PARTITION BY record_id ORDER BY idx)
        ELSE row_number() OVER (PARTITION BY record_id IS NULL, klat, klon, event_date ORDER BY idx) END AS nth FROM usable""",
    "fresh": """SELECT * FROM ranked r WHERE nth = 1 AND CASE WHEN record_id IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_record_id = r.record_id)
        ELSE NOT EXISTS (SELECT 1 FROM stored s WHERE round(s.latitude, 6) = r.klat AND round(s.longitude, 6) = r.klon
                         AND s.event_date IS NOT DISTINCT FROM r.event_date) END""",
}


def stored(dom: Domain):
    return dom.events.select(F.when(F.pmod("id", F.lit(4)) == 0, F.concat(F.col("id").cast("string"), F.lit("-1"))).alias("source_record_id"),
                             "latitude", "longitude", "event_date")


def read(dom: Domain):
    mapping = files.column_map(dom.raw_events.columns, vocab.EVENT_ALIASES)
    return ingest.reject_reasons(ingest.read_events(dom.raw_events, mapping))


@query("s04_column_mapping", """SELECT "Latitude" AS latitude, lng AS longitude, "Date" AS "date", event_type, severity, rain_24h AS rainfall_24h, "Humidity" AS humidity,
    "NDVI" AS vegetation, record_id AS source_record_id, "State" AS state, CAST(NULL AS VARCHAR) AS slope FROM raw_events""")
def s04(dom: Domain):
    view = files.logical_view(dom.raw_events.drop("_order"), vocab.EVENT_ALIASES)
    return view.select("latitude", "longitude", "date", "event_type", "severity", "rainfall_24h", "humidity", "vegetation", "source_record_id", "state", "slope")


@query("s05_tagged_load", "SELECT row_key, 'landslide_inventory' AS dataset_kind, 'external_landslide_inventory' AS source_name FROM raw_events")
def s05(dom: Domain):
    return files.tagged(dom.raw_events, "landslide_inventory", "external_landslide_inventory").select("row_key", "dataset_kind", "source_name")


@query("w02_ingestion_duplicates", """SELECT row_key, p.idx IN (SELECT idx FROM ranked WHERE nth > 1) AS is_duplicate, reasons FROM parsed p""",
       **{k: ING[k] for k in ("nums", "parsed", "usable", "ranked")})
def w02(dom: Domain):
    out = ingest.flag_duplicates(read(dom), "event_date")
    return out.select(F.col("_order.row_key").alias("row_key"), "is_duplicate", F.array_join("reasons", ";").alias("reasons"))


@query("j13_not_stored", "SELECT row_key, record_id AS source_record_id, event_date FROM fresh", **ING)
def j13(dom: Domain):
    return ingest.accept(read(dom), stored(dom), "event_date").select(F.col("_order.row_key").alias("row_key"), "source_record_id", "event_date")


@query("a06_ingestion_summary", """SELECT (SELECT count(*) FROM parsed) AS total_records, (SELECT count(*) FROM fresh) AS valid_records,
    (SELECT count(*) FROM parsed WHERE reasons <> '') AS invalid_records, (SELECT count(*) FROM fresh) AS inserted,
    (SELECT count(*) FROM usable) - (SELECT count(*) FROM fresh) AS duplicates""", **ING)
def a06(dom: Domain):
    rows = read(dom)
    return ingest.ingestion_summary(rows, ingest.accept(rows, stored(dom), "event_date"))


@query("a08_rejected_rows", """SELECT row_key, reasons, "Latitude" AS raw_latitude FROM parsed WHERE reasons <> ''""", nums=ING["nums"], parsed=ING["parsed"])
def a08r(dom: Domain):
    return ingest.rejected(read(dom)).select(F.col("_order.row_key").alias("row_key"), F.array_join("reasons", ";").alias("reasons"),
                                             F.col("raw")["Latitude"].alias("raw_latitude"))


Z02 = {**ING, "pip": CONTAINED["crossings"].replace("FROM haz p", "FROM (SELECT idx AS id, lat AS latitude, lon AS longitude FROM fresh) p"),
       "hits": CONTAINED["hits"].replace("FROM crossings", "FROM pip"), "first_hit": CONTAINED["first_hit"]}


@query("z02_ingest_events", """SELECT row_key_, latitude, longitude, state, district, event_date, event_type, severity, source_record_id,
    CAST(40 + CASE WHEN event_date IS NOT NULL THEN 20 ELSE 0 END + 15 + CASE WHEN severity IS NOT NULL THEN 15 ELSE 0 END
      + CASE WHEN coalesce(state, district) IS NOT NULL THEN 10 ELSE 0 END AS INTEGER) AS data_quality_score FROM (
    SELECT 'inv' AS row_key_, lat AS latitude, lon AS longitude, coalesce(f."State", nullif(h.name, '')) AS state,
    CASE WHEN f."State" IS NULL THEN nullif(h.name, '') END AS district, event_date, event_type, severity, record_id AS source_record_id
    FROM fresh f LEFT JOIN first_hit h ON h.id = f.idx)""", **Z02)
def z02(dom: Domain):
    done = ingestion.ingest_events(dom.raw_events, "inv", stored(dom), dom.polygons, dom.polygons)
    return done.accepted.withColumnRenamed("source_id", "row_key_")


RAW_RAIN = """SELECT l_orderkey * 10 + l_linenumber AS row_key, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS idx,
    CASE WHEN l_suppkey % 7 <> 0 THEN 'ST' || l_suppkey END AS station_id, 26 + CAST((l_suppkey * 7919) % 2000 AS DOUBLE) / 1000 AS lat,
    88 + CAST((l_suppkey * 104729) % 2000 AS DOUBLE) / 1000 AS lon, CASE WHEN l_orderkey % 50 <> 0 THEN date_trunc('day', l_shipdate) END AS observed_date,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN -l_quantity ELSE l_quantity END AS mm FROM lineitem"""


def raw_rain(dom: Domain):
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    return spread(dom.table("lineitem")).select(
        F.when(F.pmod(s, F.lit(7)) != 0, F.concat(F.lit("ST"), s.cast("string"))).alias("STATION"),
        (F.lit(26.0) + F.pmod(s * 7919, F.lit(2000)).cast("double") / F.lit(1000.0)).cast("string").alias("lat"),
        (F.lit(88.0) + F.pmod(s * 104729, F.lit(2000)).cast("double") / F.lit(1000.0)).cast("string").alias("lon"),
        F.when(F.pmod(k, F.lit(50)) != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("unknown").alias("Date"),
        F.when(F.col("l_linenumber") == 7, "trace").when(F.col("l_linenumber") == 6, (-F.col("l_quantity")).cast("string"))
        .otherwise(F.col("l_quantity").cast("string")).alias("PRCP"),
        F.struct((k * 10 + F.col("l_linenumber")).alias("row_key"), "l_partkey", s, "l_shipdate", "l_extendedprice").alias("_order"),
    )


@query("z03_ingest_rainfall", """SELECT station_id, observed_date, lat AS latitude, lon AS longitude, mm AS rainfall_mm, CAST(NULL AS VARCHAR) AS resolution FROM
    (SELECT *, row_number() OVER (PARTITION BY round(lat, 6), round(lon, 6), observed_date ORDER BY idx) AS nth FROM raw_rain WHERE mm IS NULL OR mm >= 0) WHERE nth = 1""",
       raw_rain=RAW_RAIN)
def z03(dom: Domain):
    return ingestion.ingest_rainfall(raw_rain(dom), "rain").accepted.drop("source_id", "source_record_id")


@query("z03_rainfall_summary", """SELECT count(*) AS total_records, count(DISTINCT k) FILTER (ok) AS valid_records, count(*) FILTER (NOT ok) AS invalid_records,
    count(DISTINCT k) FILTER (ok) AS inserted, count(*) FILTER (ok) - count(DISTINCT k) FILTER (ok) AS duplicates FROM
    (SELECT lat || ',' || lon || ',' || coalesce(CAST(observed_date AS VARCHAR), '') AS k, mm IS NULL OR mm >= 0 AS ok FROM raw_rain)""", raw_rain=RAW_RAIN)
def z03s(dom: Domain):
    return ingestion.ingest_rainfall(raw_rain(dom), "rain").summary


BLANKS = ["record_id", "Latitude", "lng", "Date", "severity", "event_type", "rain_24h", "Humidity", "NDVI", "State"]


@query("a10_missing_per_column", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL OR trim("{c}") = '') AS missing FROM raw_events""" for c in BLANKS))
def a10(dom: Domain):
    return ingest.missing_per_column(dom.raw_events.drop("row_key"))


@query("a11_bounding_box", """SELECT min(lat) AS min_latitude, max(lat) AS max_latitude, min(lon) AS min_longitude, max(lon) AS max_longitude FROM nums
    WHERE lat IS NOT NULL AND lon IS NOT NULL""", nums=REC["nums"])
def a11(dom: Domain):
    return ingest.bounding_box(dom.raw_events)


@query("z05_inspect", """SELECT count(*) AS records, min(lat) FILTER (lon IS NOT NULL) AS min_latitude, max(lat) FILTER (lon IS NOT NULL) AS max_latitude,
    count(*) FILTER (dt IS NULL) AS missing_dates FROM nums""", nums=REC["nums"])
def z05(dom: Domain):
    count, missing, box = ingestion.inspect(dom.raw_events)
    return count.select(
        "records", box.select("min_latitude").scalar().alias("min_latitude"), box.select("max_latitude").scalar().alias("max_latitude"),
        missing.where(F.col("column") == "Date").select("missing").scalar().alias("missing_dates"))


def _inventory(dom: Domain) -> str:
    """The messy inventory as CSV files in its own order, several of them."""
    folder = work_path(dom.spark, "inventory")
    dom.raw_events.orderBy("_order").select("row_key", *BLANKS).write.option("header", True).csv(folder)
    return f"{folder}/*.csv"


@query("p09_file_positions", """SELECT row_key, CAST(idx AS BIGINT) AS "index", 'inventory-' || idx AS location_id FROM raw_events""")
def p09_files(dom: Domain):
    """Rows numbered by their place in the files, without a sort."""
    rows = ingestion.numbered(files.read_csv(dom.spark, _inventory(dom)))
    normal = ingest.normalize_records(rows.withColumn("_order", F.struct(F.col("row_key").cast("long").alias("row_key"), "index")), "inventory", F.col("index"))
    return normal.select("_order.row_key", "_order.index", "location_id")


@query("z05_inspect_file", """SELECT 'csv' AS file_type, (SELECT count(*) FROM nums) AS records, 'Latitude' AS latitude_column, 'lng' AS longitude_column, 'Date' AS date_column,
    (SELECT count(*) FILTER (dt IS NULL) FROM nums) AS missing_dates, (SELECT string_agg(CAST(row_key AS VARCHAR), ',' ORDER BY idx) FROM (SELECT * FROM raw_events WHERE idx < 3)) AS first_rows,
    (SELECT min(lat) FILTER (lon IS NOT NULL) FROM nums) AS min_latitude, (SELECT max(lon) FILTER (lat IS NOT NULL) FROM nums) AS max_longitude""", nums=REC["nums"])
def z05_file(dom: Domain):
    seen = ingestion.inspect_file(dom.spark, _inventory(dom))
    first = F.array_join(F.transform("sample_rows", lambda r: F.get_json_object(r, "$.row_key")), ",")
    return seen.select("file_type", "records", "latitude_column", "longitude_column", "date_column", F.col("missing_cells")["Date"].alias("missing_dates"),
                       first.alias("first_rows"), "min_latitude", "max_longitude")
