"""Weather payloads, the refresh cycle and incremental ingestion as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import scoring
from talus.plans.bindings import Domain, weather_payloads
from talus.plans.catalog import CATALOG
from talus.plans.catalog.fragments import detail_view, scored_view
from talus.plans.catalog.ingestion import ING
from talus.plans.catalog.risk import LATEST
from talus.runtime import work_path
from talus.sources import weather
from talus.streaming import ingest_stream, weather_refresh

query = CATALOG.query


@query("a04_last_day_precipitation", "SELECT payload_id, rainfall_24h FROM readings")
def a04(dom: Domain):
    total = weather.last_day_precipitation(F.col("hourly"), F.col("current.time"))
    return dom.payloads.select("payload_id", total.alias("rainfall_24h"))


@query("s14_hourly_samples", "SELECT payload_id, strftime(sample_time, '%Y-%m-%dT%H:%M') AS sample_time, mm FROM hours WHERE payload_id % 19 <> 0")
def s14(dom: Domain):
    """Payloads landed as JSON files, read back with the declared schema, one row per hourly sample."""
    folder = work_path(dom.spark, "payloads")
    dom.payloads.write.json(folder)
    read = weather.read_payloads(dom.spark, folder)
    filled = read.where(F.size("hourly.precipitation") > 0)
    pairs = F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.precipitation").alias("mm"))
    return filled.select("payload_id", F.explode(pairs).alias("s")).select("payload_id", F.col("s.time").alias("sample_time"), F.col("s.mm").alias("mm"))


@query("a33_feed_status", """SELECT max(received_at) FILTER (available) AS last_refresh, arg_max(available, received_at) AS available FROM payloads""")
def a33(dom: Domain):
    return weather.feed_status(dom.payloads)


OVERLAID = """SELECT z.* REPLACE (CASE WHEN l.available THEN coalesce(l.temperature, z.temperature) ELSE z.temperature END AS temperature,
    CASE WHEN l.available THEN coalesce(l.humidity, z.humidity) ELSE z.humidity END AS humidity,
    CASE WHEN l.available THEN coalesce(l.rainfall_24h, z.rainfall_24h) ELSE z.rainfall_24h END AS rainfall_24h), coalesce(l.available, false) AS seen
    FROM zones z LEFT JOIN latest l ON l.zone_id = z.id"""
CYCLE = {"latest": LATEST, "overlaid": OVERLAID, "detail": detail_view("overlaid"), "scored": scored_view()}


def cycle(dom: Domain) -> weather_refresh.RefreshTables:
    """The supplied event table as a stream of payloads, run through one refresh cycle."""
    root = work_path(dom.spark, "refresh")
    tables = weather_refresh.RefreshTables(root)
    tables.start(dom.zones)
    schema = dom.table("events").schema
    # A pattern, which a stream source takes for one file as well as for a folder of part files.
    raw = dom.spark.readStream.schema(schema).parquet(f"{dom.folder}/events.parque[t]")
    running = weather_refresh.start(weather_payloads(raw), tables, f"{root}/checkpoint")
    running.awaitTermination()
    return tables


@query("t01_refresh_cycle", "SELECT id, temperature, humidity, rainfall_24h, risk_score, risk_level FROM scored", **CYCLE)
def t01(dom: Domain):
    tables = cycle(dom)
    version = weather_refresh.latest_version(dom.spark, tables)
    return tables.zones(dom.spark, version).select("id", "temperature", "humidity", "rainfall_24h", "risk_score", "risk_level")


BATCHES = 3


def _three_cycles() -> dict[str, str]:
    """Zones and levels after each of three batches of payloads, batch k holding those with payload_id % 3 = k."""
    views, zones = {}, "zones"
    for k in range(BATCHES):
        views[f"latest{k}"] = LATEST.replace("FROM readings", f"FROM (SELECT * FROM readings WHERE payload_id % {BATCHES} = {k})")
        views[f"overlaid{k}"] = OVERLAID.replace("FROM zones z LEFT JOIN latest l", f"FROM {zones} z LEFT JOIN latest{k} l")
        views[f"detail{k}"] = detail_view(f"overlaid{k}")
        views[f"scored{k}"] = scored_view(f"detail{k}")
        zones = f"(SELECT * EXCLUDE (seen, guarded, f_rainfall, f_slope, f_vegetation, f_historical, f_humidity) FROM scored{k})"
    # A level of its own where no alert is kept: below HIGH, or not scored.
    views["levels"] = " UNION ALL ".join(
        f"SELECT id, {k} AS batch, CASE WHEN guarded OR risk_level NOT IN ('HIGH', 'CRITICAL') THEN '' ELSE risk_level END AS level FROM scored{k}"
        for k in range(BATCHES))
    views["turns"] = "SELECT *, lag(level, 1, '') OVER (PARTITION BY id ORDER BY batch) AS before FROM levels"
    return views


def _three_batches(dom: Domain) -> weather_refresh.RefreshTables:
    """The event table as payloads in three folders that arrive one after the other."""
    root = work_path(dom.spark, "refresh3")
    tables = weather_refresh.RefreshTables(root)
    tables.start(dom.zones)
    payloads = dom.payloads
    for k in range(BATCHES):
        payloads.where(F.col("payload_id") % BATCHES == k).write.json(f"{root}/landed/part={k}")
        stream = weather.stream_payloads(dom.spark, f"{root}/landed/*")
        weather_refresh.start(stream, tables, f"{root}/checkpoint").awaitTermination()
    return tables


@query("t01_alert_history", """SELECT t.id AS zone_id, t.level AS severity, CAST(t.batch AS INTEGER) AS opened_in,
    CAST((SELECT min(l.batch) FROM levels l WHERE l.id = t.id AND l.batch > t.batch AND l.level <> t.level) AS INTEGER) AS closed_in
    FROM turns t WHERE t.level <> '' AND t.level <> t.before""", **_three_cycles())
def t01_history(dom: Domain):
    """Every alert of three cycles: carried over, resolved, and raised again."""
    tables = _three_batches(dom)
    read = lambda name: dom.spark.read.parquet(f"{tables.root}/{name}")
    opened = read("opened_alerts").select("zone_id", "severity", F.col("batch").alias("opened_in"))
    closed = read("closed_zones").select(F.col("zone_id").alias("z"), F.col("batch").alias("closed_in"))
    met = opened.join(closed, (F.col("zone_id") == F.col("z")) & (F.col("closed_in") > F.col("opened_in")), "left")
    return met.groupBy("zone_id", "severity", "opened_in").agg(F.min("closed_in").alias("closed_in"))


@query("t01_zones_after_three", "SELECT id, temperature, humidity, rainfall_24h, risk_level FROM scored2", **_three_cycles())
def t01_after(dom: Domain):
    """Carried state after three batches. Scores are compared by t01_refresh_cycle; here some lie on a rounding edge, where the two engines
    differ."""
    tables = _three_batches(dom)
    version = weather_refresh.latest_version(dom.spark, tables)
    return tables.zones(dom.spark, version).select("id", "temperature", "humidity", "rainfall_24h", "risk_level")


@query("t04_audit_log", """SELECT id AS zone_id, 'stream_refresh' AS triggered_by, CASE WHEN guarded THEN 'unavailable_derived_zone_no_real_environment'
    ELSE 'rule_based_fallback' END AS prediction_source, rainfall_24h AS input_rainfall_24h, NOT guarded AS knows_rainfall, risk_score, risk_level FROM scored""", **CYCLE)
def t04(dom: Domain):
    log = dom.spark.read.parquet(f"{cycle(dom).root}/risk_log")
    return log.select("zone_id", "triggered_by", "prediction_source", F.col("inputs.rainfall_24h").alias("input_rainfall_24h"),
                      F.coalesce(F.try_element_at("data_availability", F.lit("rainfall_24h")), F.lit(False)).alias("knows_rainfall"), "risk_score", "risk_level")


@query("a25_refresh_result", """SELECT count(*) AS total_zones, count(*) FILTER (seen) AS updated, count(*) FILTER (NOT seen) AS weather_unavailable, count(*) AS risk_updated,
    count(*) FILTER (NOT guarded AND risk_level IN ('HIGH', 'CRITICAL')) AS alerts_generated FROM scored""", **CYCLE)
def a25(dom: Domain):
    readings = weather.latest_per_zone(weather.readings(dom.payloads))
    scored = scoring.score_zones(scoring.overlay_weather(dom.zones, readings))
    none_open = dom.alerts.withColumn("is_active", F.lit(False))
    return weather_refresh.refresh_result(scored, none_open)


@query("t05_incremental_ingestion", """SELECT count(*) AS stored, count(DISTINCT k) AS distinct_keys FROM (SELECT DISTINCT coalesce(record_id, lat || ',' || lon || ',' ||
    coalesce(CAST(event_date AS VARCHAR), '')) AS k FROM parsed WHERE reasons = '')""", **{
    k: v for k, v in ING.items() if k in ("nums", "parsed")})
def t05(dom: Domain):
    """The same inventory dropped into a folder twice: the second copy adds nothing."""
    root = work_path(dom.spark, "dropped")
    raw = dom.raw_events.drop("_order", "row_key")
    for copy in ("first", "second"):
        raw.write.option("header", True).csv(f"{root}/in/{copy}")
        rows = ingest_stream.stream_csv(dom.spark, f"{root}/in/*", raw.columns)
        ingest_stream.start(rows, f"{root}/table", "inv", "historical_landslide", f"{root}/checkpoint").awaitTermination()
    table = dom.spark.read.parquet(f"{root}/table")
    key = F.coalesce("source_record_id", F.concat_ws(",", F.col("latitude").cast("string"), F.col("longitude").cast("string"),
                                                     F.coalesce(F.col("event_date").cast("string"), F.lit(""))))
    return table.agg(F.count("*").alias("stored"), F.countDistinct(key).alias("distinct_keys"))


def _three_drops() -> dict[str, str]:
    """Rows stored after each of three files, file k holding the rows with row_key % 3 = k: the first of every key in its file
    that no earlier file stored. Every stored row blocks its place and time, those with a record id their id, too."""
    views = {k: ING[k] for k in ("nums", "parsed", "usable")}
    known = None
    for k in range(BATCHES):
        views[f"ranked_{k}"] = ING["ranked"].replace("FROM usable", f"FROM (SELECT * FROM usable WHERE row_key % {BATCHES} = {k})")
        views[f"fresh_{k}"] = f"SELECT * FROM ranked_{k} WHERE nth = 1" if known is None else (
            ING["fresh"].replace("FROM ranked r", f"FROM ranked_{k} r").replace("FROM stored s", f"FROM ({known}) s"))
        part = f"SELECT record_id AS source_record_id, lat AS latitude, lon AS longitude, event_date FROM fresh_{k}"
        known = part if known is None else f"{known} UNION ALL {part}"
    views["kept"] = " UNION ALL ".join(f"SELECT {k} AS drop_no, * FROM fresh_{k}" for k in range(BATCHES))
    return views


def dropped(raw: DataFrame, k: int) -> DataFrame:
    """The rows of the kth drop in their order, cut into ranges, which are written as consecutive files."""
    return raw.where(F.pmod(F.col("_order.row_key"), F.lit(BATCHES)) == k).repartitionByRange("_order").sortWithinPartitions("_order")


@query("t05_three_batches", """SELECT CAST(drop_no AS INTEGER) AS drop_no, record_id AS source_record_id, lat AS latitude, lon AS longitude, event_date, severity
    FROM kept""", **_three_drops())
def t05_three(dom: Domain):
    """Three files arrive one after the other; a row is stored by the first file that has its key."""
    root = work_path(dom.spark, "three-drops")
    raw = dom.raw_events
    columns = [c for c in raw.columns if c not in ("_order", "row_key")]
    for k in range(BATCHES):
        dropped(raw, k).select(*columns).write.option("header", True).csv(f"{root}/in/part{k}")
        rows = ingest_stream.stream_csv(dom.spark, f"{root}/in/*", columns)
        ingest_stream.start(rows, f"{root}/table", "inv", "historical_landslide", f"{root}/checkpoint").awaitTermination()
    stored = dom.spark.read.parquet(f"{root}/table")
    return stored.select(F.regexp_extract("batch", r"(\d+)$", 1).cast("int").alias("drop_no"), "source_record_id", "latitude", "longitude",
                         "event_date", "severity")
