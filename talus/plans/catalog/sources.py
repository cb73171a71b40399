"""Readers, writers, provenance. Files are written from the supplied tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import features
from talus.plans import ingestion
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.features import CRITICAL, LABELLED, feature_views, labelled_features
from talus.plans.catalog.ingestion import REC
from talus.plans.catalog.expressions import REC_MISSING, REC_SCORE
from talus.runtime import SPREAD_TASKS, work_path
from talus.sources import boundaries, files, registry, sinks

query = CATALOG.query


@query("s01_csv_inventory", """SELECT record_id, "Latitude", lng, nullif("Date", '') AS "Date", severity, "State" FROM raw_events""")
def s01(dom: Domain):
    folder = work_path(dom.spark, "csv")
    dom.raw_events.drop("_order", "row_key").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(folder)
    return files.read_csv(dom.spark, f"{folder}/*.csv").select("record_id", "Latitude", "lng", "Date", "severity", "State")


def write_geojson(dom: Domain) -> str:
    """Events as GeoJSON documents of at most 1000 features; every seventh carries its own longitude."""
    k = F.col("id")
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    own = F.when(F.pmod(k, F.lit(7)) == 0, F.create_map(F.lit("longitude"), F.lit("12.5"))).otherwise(F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("record_id"), k.cast("string"), F.lit("event_type"), F.col("event_type"))
    feature = F.struct(F.lit("Feature").alias("type"), F.map_concat(base, own).alias("properties"),
                       F.when(F.pmod(k, F.lit(11)) != 0, point).alias("geometry"))
    docs = dom.events.groupBy(F.floor(k / 1000).alias("doc")).agg(F.collect_list(feature).alias("features"))
    folder = work_path(dom.spark, "geojson")
    docs.select("doc", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.partitionBy("doc").text(folder)
    return folder


@query("s02_geojson_inventory", """SELECT CAST(id AS VARCHAR) AS record_id, event_type, CASE WHEN id % 7 = 0 THEN '12.5' WHEN id % 11 <> 0 THEN CAST(longitude AS VARCHAR) END AS longitude,
    CASE WHEN id % 11 <> 0 THEN CAST(latitude AS VARCHAR) END AS latitude FROM haz""")
def s02(dom: Domain):
    return files.read_geojson(dom.spark, f"{write_geojson(dom)}/*/*.txt").select("record_id", "event_type", "longitude", "latitude")


@query("s03_read_by_suffix", """SELECT 'landslide_inventory' AS dataset_kind, 'external_landslide_inventory' AS source_name, count(*) AS "rows" FROM haz""")
def s03(dom: Domain):
    folder = work_path(dom.spark, "byname")
    dom.events.select(F.col("id").cast("string").alias("record_id"), "latitude", "longitude").write.option("header", True).csv(folder)
    rows = files.read_inventory(dom.spark, f"{folder}/*.csv")
    return rows.groupBy("dataset_kind", "source_name").agg(F.count("*").alias("rows"))


@query("s06_boundary_edges", "SELECT feature, name, part, ring, count(*) AS vertices FROM edges GROUP BY 1, 2, 3, 4")
def s06(dom: Domain):
    """Nation boundaries written as one GeoJSON file and read back as polygon rings."""
    ring = lambda r: F.transform(r["points"], lambda v: F.array(v["x"], v["y"]))
    of_part = lambda p: F.transform(F.array_sort(F.filter("rings", lambda r: r["part"] == p), lambda a, b: a["ring"] - b["ring"]), ring)
    multi = F.exists("rings", lambda r: r["part"] == 1)
    polygon = F.to_json(of_part(0))
    both = F.concat(F.lit("["), polygon, F.lit(","), F.to_json(of_part(1)), F.lit("]"))
    geometry = F.concat(F.lit('{"type":"'), F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), F.when(multi, both).otherwise(polygon), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{'), F.coalesce(F.concat(F.lit('"NAME":"'), F.col("name"), F.lit('"')), F.lit("")), F.lit('},"geometry":'), geometry, F.lit("}"))
    # 25 nations make one file, in feature order.
    doc = dom.polygons.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature", feature.alias("t")))), lambda x: x["t"]), ",").alias("all"))
    folder = work_path(dom.spark, "boundary")
    doc.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("all"), F.lit("]}")).alias("value")).coalesce(1).write.text(folder)
    from talus.operators.polygons import ring_edges

    edges = ring_edges(boundaries.read_polygons(dom.spark, f"{folder}/*.txt"))
    # Closing the ring repeats its first vertex, which adds one edge of length zero.
    return edges.where("ax <> bx OR ay <> by").groupBy("feature", "name", "part", "ring").agg(F.count("*").alias("vertices"))


@query("s09_file_checksums")
def s09(dom: Domain):
    """Checksum and size of every supplied file."""
    return files.checksums(dom.spark, f"{dom.folder}/*.parquet")


@query("s09_text_checksums", """SELECT doc, sha256(body) AS checksum_sha256, octet_length(encode(body)) AS file_size_bytes FROM
    (SELECT id // 100 AS doc, string_agg(id || ',' || coalesce(event_type, ''), ';' ORDER BY id) || chr(10) AS body FROM haz GROUP BY 1)""")
def s09_texts(dom: Domain):
    """Text files of a hundred events each, written and read back whole."""
    line = F.concat_ws(",", F.col("id").cast("string"), F.coalesce("event_type", F.lit("")))
    # A task makes its files one after the other, so the few bytes of the texts are dealt over all cores.
    tasks = SPREAD_TASKS * dom.spark.sparkContext.defaultParallelism
    rows = dom.events.select(F.expr("id div 100").alias("doc"), "id", line.alias("line")).repartition(tasks, "doc")
    docs = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("lines"))
    folder = work_path(dom.spark, "texts")
    text = F.array_join(F.transform("lines", lambda x: x["line"]), ";").alias("value")
    # One file per record in one folder, since a folder of its own costs as much as the file; every task moves its own files.
    docs.select(text).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    first = F.regexp_extract(F.decode("content", "UTF-8"), r"^(-?\d+),", 1)
    # Spark writes a file without a byte for a first task without a row.
    return files.checksums(dom.spark, folder, first.alias("id")).where("file_size_bytes > 0").select(
        F.expr("try_cast(id AS BIGINT) div 100").alias("doc"), "checksum_sha256", "file_size_bytes")


@query("s10_written_records", f"""SELECT 'inventory-' || idx AS location_id, CAST({REC_SCORE} AS VARCHAR) AS data_quality_score, {REC_MISSING} AS missing_features FROM judged WHERE errors = ''""", **REC)
def s10(dom: Domain):
    validated, scored = ingestion.validate_inventory(dom.raw_events, "inventory")
    folder = work_path(dom.spark, "records")
    sinks.write_records(validated, scored, folder, "/somewhere/inventory.csv")
    return files.read_csv(dom.spark, f"{folder}/records/*.csv").select("location_id", "data_quality_score", "missing_features")


@query("s10_record_metadata", f"""SELECT 'inventory.csv' AS source_landslide_file, (SELECT count(*) FROM judged) AS total_input_records, (SELECT count(*) FROM judged WHERE errors = '') AS valid_records,
    (SELECT count(*) FROM judged WHERE errors <> '') AS invalid_records, string_agg(f, ';' ORDER BY f) AS missing FROM (SELECT DISTINCT unnest(string_split(m, ';')) AS f FROM
    (SELECT {REC_MISSING} AS m FROM judged WHERE errors = '') WHERE m <> '')""", **REC)
def s10m(dom: Domain):
    validated, scored = ingestion.validate_inventory(dom.raw_events, "inventory")
    return sinks.record_metadata(validated, scored, "/somewhere/inventory.csv").select(
        "source_landslide_file", "total_input_records", "valid_records", "invalid_records", F.array_join("missing_features_observed", ";").alias("missing"))


@query("s11_feature_dataset", f"SELECT point_id, label, rainfall_30d, elevation_m FROM feat WHERE {CRITICAL}", **feature_views(LABELLED))
def s11(dom: Domain):
    rows = labelled_features(dom)
    folder = work_path(dom.spark, "features")
    sinks.write_features(features.training_rows(rows), features.training_metadata(rows), folder)
    return dom.spark.read.parquet(f"{folder}/rows").select("point_id", "label", "rainfall_30d", "elevation_m")


@query("s12_append_batches", "SELECT source_id, count(*) AS stored FROM haz GROUP BY 1")
def s12(dom: Domain):
    """Three batches, one of them run twice: every row is stored once."""
    table = work_path(dom.spark, "appended")
    for i, batch in enumerate(["a", "b", "c", "b"]):
        part = {"a": 0, "b": 1, "c": 2}[batch]
        sinks.append_batch(dom.events.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part), table, batch)
    return dom.spark.read.parquet(table).groupBy("source_id").agg(F.count("*").alias("stored"))


@query("s13_stored_negatives", """SELECT 'negative_' || id AS point_id, 26 + CAST((id * 6007) % 20000 AS DOUBLE) / 10000 AS latitude FROM zones""")
def s13(dom: Domain):
    from talus.plans.catalog.features import given_negatives

    return sinks.write_negatives(given_negatives(dom), work_path(dom.spark, "negatives")).select("point_id", "latitude")


@query("s15_register_sources", """SELECT coalesce(n.source_id, e.source_id) AS source_id, CASE WHEN n.source_id IS NOT NULL THEN n.category ELSE e.category END AS category,
    CASE WHEN n.source_id IS NOT NULL THEN 'registered' ELSE e.last_status END AS last_status, CASE WHEN n.source_id IS NULL THEN e.last_error END AS last_error,
    coalesce(e.registered_at, TIMESTAMP '2024-06-01') AS registered_at FROM known e FULL JOIN (SELECT * FROM sources WHERE category <> 'boundary') n ON n.source_id = e.source_id""",
       known="""SELECT source_id, 'terrain' AS category, status AS last_status, error_summary AS last_error, started_at AS registered_at FROM
        (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rn FROM runs WHERE status = 'failed') WHERE rn = 1""")
def s15(dom: Domain):
    """Sources that ever failed are known already; all but the boundary sources register (again)."""
    failed = registry.current_status(dom.runs.where("status = 'failed'"))
    known = failed.select("source_id", F.lit("terrain").alias("category"), "last_status", "last_error", F.col("started_at").alias("registered_at"))
    new = dom.sources.where("category <> 'boundary'").select("source_id", "category")
    return registry.register(known, new, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


@query("s16_source_status", """SELECT s.source_id, CASE WHEN r.id IS NULL THEN 'registered' ELSE r.status END AS last_status, coalesce(r.status = 'processed', false) AS processed
    FROM sources s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rn FROM runs) r ON r.source_id = s.source_id AND rn = 1""")
def s16(dom: Domain):
    latest = registry.current_status(dom.runs)
    return dom.sources.select("source_id").join(latest, "source_id", "left").select(
        "source_id", F.coalesce("last_status", F.lit("registered")).alias("last_status"), F.coalesce("processed", F.lit(False)).alias("processed"))


@query("s16_run_life_cycle", """SELECT 'inventory' AS source_id, 'processed' AS last_status, count(*) AS total_records, false AS has_error FROM haz
    UNION ALL SELECT 'lost', 'failed', NULL, true""")
def s16_runs(dom: Domain):
    """Two runs on record: a written inventory that is read in, and a folder that does not exist."""
    folder, runs = work_path(dom.spark, "inventory"), work_path(dom.spark, "runs")
    dom.events.select(F.col("id").cast("string").alias("record_id"), "latitude", "longitude").write.option("header", True).csv(folder)
    for source, place in (("inventory", folder), ("lost", f"{folder}-lost")):
        try:
            ingestion.tracked_file(dom.spark, f"{place}/*.csv", source, "historical_landslide", work_path(dom.spark, "stored"), f"run-{source}", runs)
        except files.DatasetError:
            continue  # on record as failed
    stored = dom.spark.read.parquet(runs)
    latest = registry.current_status(stored).select("source_id", F.col("run_id").alias("id"), "last_status", F.col("last_error").isNotNull().alias("has_error"))
    return latest.join(stored.select("source_id", "id", "total_records"), ["source_id", "id"]).select(
        "source_id", "last_status", "total_records", "has_error")
