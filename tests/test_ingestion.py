"""Fixture files through the readers and ingestion jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from talus.operators import ingest, polygons, rainfall
from talus.plans import ingestion
from talus.sources.known_keys import KnownKeys
from talus.sources import boundaries, files, registry, sinks
from talus.streaming import ingest_stream

EVENTS_CSV = """﻿record_id,Latitude,lng,Date,severity,event_type
EV001,27.041,88.2636,2023-07-12,HIGH,debris_flow
EV002,25.5788,91.8933,,MODERATE,rock_fall
EV003,999,88.4756,2023-06-20,LOW,slide
EV001,27.041,88.2636,2023-07-12,HIGH,debris_flow
EV004,23.7271,92.7176,2023-09-01,,
"""
RAIN_CSV = """station_id,latitude,longitude,date,rainfall_mm
RF001,27.041,88.2636,2023-07-10,12.5
RF001,27.041,88.2636,2023-07-11,45.2
RF001,27.041,88.2636,,30.0
RF002,25.5788,91.8933,2023-07-10,-5.0
RF002,25.5788,91.8933,2023-07-15,8.0
"""


def box(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


EVENTS_GEOJSON = {
    "type": "FeatureCollection",
    "features": [
        feature("Point", [88.2636, 27.041], record_id="GJ001", date="2023-08-01", severity="HIGH", event_type="debris_flow"),
        feature("Point", [91.8933, 25.5788]),
        {"type": "Feature", "geometry": None, "properties": {"record_id": "GJ003", "date": "2023-08-05"}},
        feature("Point", [], record_id="GJ004"),
    ],
}
STATES = {
    "type": "FeatureCollection",
    "features": [
        feature("Polygon", [box(85, 25, 90, 30), box(86, 26, 87, 27)], name="A"),
        feature("MultiPolygon", [[box(90, 24, 94, 28)], [box(96, 24, 97, 25)]], NAME="", STATE="B"),
        feature("Polygon", [box(89, 29, 92, 31)], name="C"),
        feature("Polygon", [box(70, 10, 72, 12)]),
        feature("Polygon", [box(71, 11, 73, 13)], name="D"),
    ],
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "events.csv").write_text(EVENTS_CSV, encoding="utf-8")
    (tmp_path / "rain.csv").write_text(RAIN_CSV)
    (tmp_path / "events.geojson").write_text(json.dumps(EVENTS_GEOJSON, indent=1))
    (tmp_path / "states.geojson").write_text(json.dumps(STATES))
    return tmp_path


def one(df):
    return df.first().asDict()


def test_aliases():
    mapping = files.column_map(["ID", "LAT", "Lng", "eventDate", "when"], {"date": ["eventDate"], "new": ["WHEN"]})
    assert (mapping["location_id"], mapping["latitude"], mapping["longitude"]) == ("ID", "LAT", "Lng")
    assert (mapping["date"], mapping["new"], mapping["slope"]) == ("eventDate", "when", None)


def test_file_types(spark, tmp_path):
    assert (files.file_type("a/B.CSV"), files.file_type("x.json"), files.file_type("x.geojson")) == ("csv", "geojson", "geojson")
    with pytest.raises(files.DatasetError, match="Unsupported"):
        files.file_type("x.tif")
    with pytest.raises(files.DatasetError, match="File not found: gone.csv"):
        files.read_csv(spark, str(tmp_path / "gone.csv"))


def test_event_csv(spark, folder):
    raw = files.read_dataset(spark, str(folder / "events.csv"))
    assert raw.columns[0] == "record_id"
    done = ingestion.ingest_events(raw, "src")
    assert one(done.summary) == {"total_records": 5, "valid_records": 3, "invalid_records": 1, "inserted": 3, "duplicates": 1}
    assert {r["source_record_id"]: r["data_quality_score"] for r in done.accepted.collect()} == {"EV001": 90, "EV002": 70, "EV004": 60}
    bad = done.rejected.collect()
    assert [r["reasons"] for r in bad] == [["invalid_latitude"]] and bad[0]["raw"]["record_id"] == "EV003"
    again = ingestion.ingest_events(raw, "src", done.accepted)
    assert one(again.summary)["inserted"] == 0 and one(again.summary)["duplicates"] == 4


def test_event_geojson(spark, folder):
    done = ingestion.ingest_events(files.read_dataset(spark, str(folder / "events.geojson")), "src")
    assert one(done.summary) == {"total_records": 4, "valid_records": 2, "invalid_records": 2, "inserted": 2, "duplicates": 0}
    assert [r["reasons"] for r in done.rejected.collect()] == [["missing_coordinates"]] * 2


def test_geojson_keeps_a_present_null(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"longitude": None, "x": 1},
                                                      "geometry": {"type": "Point", "coordinates": [5.5, 6.5]}}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    row = files.read_geojson(spark, str(tmp_path / "p.json")).drop("_order").first()
    assert row.asDict() == {"latitude": "6.5", "longitude": None, "x": "1"}


def test_rainfall_csv(spark, folder):
    raw = files.read_dataset(spark, str(folder / "rain.csv"))
    done = ingestion.ingest_rainfall(raw, "rain")
    assert one(done.summary) == {"total_records": 5, "valid_records": 4, "invalid_records": 1, "inserted": 4, "duplicates": 0}
    assert [r["reasons"] for r in done.rejected.collect()] == [["invalid_rainfall"]]
    points = spark.createDataFrame(
        [(1, 27.041, 88.2636, dt.datetime(2023, 7, 11)), (2, 27.041, 88.2636, dt.datetime(2024, 1, 1))],
        "point_id long, latitude double, longitude double, as_of timestamp_ntz")
    first, second = rainfall.rainfall_summary(points, done.accepted).orderBy("point_id").collect()
    assert first["nearest_station_id"] == "RF001" and first["nearest_station_distance_km"] == 0.0
    assert [first[w] for w in ("rainfall_24h", "rainfall_72h", "rainfall_7d", "rainfall_30d")] == [57.7] * 4
    assert first["rainfall_24h_observation_count"] == 2 and first["antecedent_rainfall_index"] == 56.45
    assert not second["rainfall_available"] and second["rainfall_30d"] is None and second["rainfall_30d_observation_count"] == 0


def test_boundaries(spark, folder):
    regions = boundaries.read_polygons(spark, str(folder / "states.geojson"))
    cases = {"A": (27.041, 88.2636), "B": (26.1445, 91.7362), "hole": (26.5, 86.5), "part two": (24.5, 96.5), "first wins": (29.5, 89.5),
             "only third": (30.5, 91.0), "no name": (11.5, 71.5), "later": (12.5, 72.5), "nowhere": (10.0, 10.0)}
    points = spark.createDataFrame([(k, *v) for k, v in cases.items()], "k string, latitude double, longitude double")
    for size in (0.05, 0.7, 3.0):
        got = {r["k"]: r["region"] for r in polygons.locate(points, regions, size=size).collect()}
        assert got == {"A": "A", "B": "B", "hole": None, "part two": "B", "first wins": "A", "only third": "C", "no name": None, "later": "D", "nowhere": None}
    assert boundaries.status(spark, {"state": str(folder / "states.geojson"), "district": str(folder / "none.geojson"), "country": None}) == {
        "state": {"configured": True, "available": True}, "district": {"configured": True, "available": False},
        "country": {"configured": False, "available": False}}


def test_states_fill_only_gaps(spark, folder):
    regions = boundaries.read_polygons(spark, str(folder / "states.geojson"))
    raw = files.read_dataset(spark, str(folder / "events.csv"))
    done = ingestion.ingest_events(raw.withColumn("State", F.when(F.col("record_id") == "EV002", "Given")), "src", None, regions, regions)
    assert {r["source_record_id"]: (r["state"], r["district"]) for r in done.accepted.collect()} == {
        "EV001": ("A", "A"), "EV002": ("Given", None), "EV004": (None, None)}


def test_validation_pass(spark):
    rows = [("1", "1", "2020-01-01", "-1"), ("1", "1", "2020-01-01", "5"), (None, None, None, "5"), ("x", "", " ", "5"), ("2", "2", "", "5")]
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lat string, lon string, date string, rain_24h string, _order int")
    validated, scored = ingestion.validate_inventory(raw, "inv")
    errors = {r["_order"]: r["errors"] for r in validated.collect()}
    # the invalid first row still claims its key; all-NULL keys are never duplicates
    assert errors == {0: ["invalid_rainfall_24h"], 1: ["duplicate_record"], 2: ["missing_coordinates"], 3: ["missing_coordinates"], 4: []}
    assert one(ingest.validation_summary(validated)) == {"total_records": 5, "valid_records": 1, "invalid_records": 4, "missing_coordinates": 2, "duplicates": 1}
    assert [r["location_id"] for r in scored.collect()] == ["inv-4"]


def test_rejected_rows_claim_no_key(spark):
    rows = [("A", "999", "1"), ("A", "5", "5"), ("A", "5", "5")]
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "record_id string, lat string, lon string, _order int")
    done = ingestion.ingest_events(raw, "s")
    assert one(done.summary) == {"total_records": 3, "valid_records": 1, "invalid_records": 1, "inserted": 1, "duplicates": 1}
    flagged = ingest.flag_duplicates(done.rows, "event_date").orderBy("_order").collect()
    assert [r["is_duplicate"] for r in flagged] == [False, False, True]


def test_ingest_file_twice(spark, folder, tmp_path):
    table = str(tmp_path / "table")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    run = lambda batch: one(ingestion.ingest_file(spark, str(folder / "events.csv"), "src", "historical_landslide", table, batch, at=at))
    assert (run("b1")["inserted"], run("b2")["inserted"], run("b1")["inserted"]) == (3, 0, 3)
    assert spark.read.parquet(table).count() == 3


def test_runs_on_record(spark, folder, tmp_path):
    runs, table = str(tmp_path / "runs"), str(tmp_path / "t")
    ingestion.tracked_file(spark, str(folder / "events.csv"), "good", "historical_landslide", table, "r1", runs)
    with pytest.raises(files.DatasetError):
        ingestion.tracked_file(spark, str(folder / "absent.csv"), "bad", "historical_landslide", table, "r2", runs)
    found = {r["id"]: r for r in spark.read.parquet(runs).collect()}
    assert (found["r1"]["status"], found["r1"]["inserted"], found["r1"]["error_summary"]) == ("processed", 3, None)
    assert found["r1"]["started_at"] <= found["r1"]["completed_at"]
    assert found["r2"]["status"] == "failed" and "absent.csv" in found["r2"]["error_summary"] and found["r2"]["inserted"] is None


def test_ingest_registers_its_file(spark, folder, tmp_path):
    """Name, size and checksum come from the file; the outcome of the run is on record with the source."""
    import hashlib

    sources, runs, table = (str(tmp_path / n) for n in ("sources", "runs", "t"))
    body = (folder / "events.csv").read_bytes()
    ingestion.tracked_file(spark, str(folder / "events.csv"), "inv", "historical_landslide", table, "r1", runs, sources, "Inventory")
    row = one(registry.registered(spark, sources, "inv"))
    assert (row["file_name"], row["file_size_bytes"], row["checksum_sha256"]) == ("events.csv", len(body), hashlib.sha256(body).hexdigest())
    assert (row["name"], row["last_status"], row["last_error"]) == ("Inventory", "processed", None)
    ingestion.tracked_file(spark, str(folder / "rain.csv"), "wet", "rainfall", table + "2", "r2", runs, sources)
    ingestion.tracked_file(spark, str(folder / "events.csv"), "inv", "historical_landslide", table, "r3", runs, sources)
    again = one(registry.registered(spark, sources, "inv"))
    assert again["registered_at"] == row["registered_at"] and again["name"] == "inv"
    with pytest.raises(Exception, match="unknown category"):
        ingestion.tracked_file(spark, str(folder / "events.csv"), "odd", "historical_landslide", table, "r4", runs, sources, registered_as="music")
    with pytest.raises(files.DatasetError):
        ingestion.tracked_file(spark, str(folder / "absent.csv"), "inv", "historical_landslide", table, "r5", runs, None)
    assert {r["source_id"] for r in spark.read.parquet(sources).collect()} == {"inv", "wet"}


def test_known_keys_prune_and_replace(spark, tmp_path):
    """Only the buckets of the batch are read, keys of an own earlier try do not count, rows without stored keys do."""
    table = str(tmp_path / "table")
    rows = lambda ids: spark.createDataFrame([(None if i % 2 else f"R{i}", 10.0 + i, -0.0, None, "src") for i in ids],
                                             "source_record_id string, latitude double, longitude double, event_date timestamp_ntz, source_id string")
    known = lambda batch: KnownKeys(spark, table, "src", batch, "event_date")
    sinks.append_batch(rows(range(40)), table, "a b/1")
    known("a b/1").remember(rows(range(40)))
    sinks.append_batch(rows(range(40, 50)), table, "2")          # its keys were never finished
    firsts = spark.createDataFrame([(f"R{i}" if i % 2 == 0 else None, None if i % 2 == 0 else 10.0 + i, None if i % 2 == 0 else 0.0, None, i) for i in range(60)],
                                   "k_id string, k_lat double, k_lon double, k_date timestamp_ntz, i int")
    left = lambda batch: sorted(r["i"] for r in known(batch).unknown(firsts).collect())
    assert left("3") == list(range(50, 60)) and left("2") == list(range(40, 60)) and left("a b/1") == [*range(40), *range(50, 60)]
    plan = known("3").stored([5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    sinks.append_batch(rows(range(3)), table, "a b/1")           # a smaller second try leaves nothing of the first
    assert spark.read.parquet(table).where("batch = 'a b/1'").count() == 3


def test_stream_ingest_is_idempotent(spark, folder, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    table, checkpoint = str(tmp_path / "streamed"), str(tmp_path / "cp")
    headers = ["station_id", "latitude", "longitude", "date", "rainfall_mm"]
    for name in ("one.csv", "two.csv"):
        (drop / name).write_text(RAIN_CSV)
        ingest_stream.start(ingest_stream.stream_csv(spark, str(drop), headers), table, "rain", "rainfall", checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 4
    # the same batch again replaces itself
    rows = spark.read.option("header", True).csv(str(drop)).select("*", F.lit("f").alias("_file"), F.lit(0).alias("_block"))
    ingest_stream.ingest_batch(rows, 0, table, "rain", "rainfall")
    assert spark.read.parquet(table).count() == 4


def test_written_records_and_metadata(spark, folder, tmp_path):
    validated, scored = ingestion.validate_inventory(files.read_dataset(spark, str(folder / "events.csv")), "inv")
    sinks.write_records(validated, scored, str(tmp_path / "out"), "/secret/place/events.csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "out/records"))
    assert back.columns == sinks.RECORD_COLUMNS and back.count() == 3
    meta = spark.read.json(str(tmp_path / "out/metadata")).first()
    assert (meta["source_landslide_file"], meta["total_input_records"], meta["valid_records"], meta["invalid_records"]) == ("events.csv", 5, 3, 2)
    assert meta["missing_features_observed"] == sorted(meta["missing_features_observed"])


def test_long_files_are_summed_piece_by_piece(spark, tmp_path, monkeypatch):
    """A file beyond the limit of the binary-file source ended the job."""
    import hashlib

    for name, size in {"a.bin": 10, "b c%20.bin": 5000, "d.bin": 9001}.items():
        (tmp_path / name).write_bytes(bytes(i * 7 % 251 for i in range(size)))
    monkeypatch.setattr(files, "PIECE_BYTES", 1000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {tuple(r) for r in files.checksums(spark, f"{tmp_path}/*.bin").collect()}
        assert files._streamed_sum(spark, str(tmp_path / "d.bin")) == hashlib.sha256((tmp_path / "d.bin").read_bytes()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {(f.name, hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size) for f in tmp_path.iterdir()}


def test_checksums(spark, folder):
    import hashlib

    rows = {r["file_name"]: r for r in files.checksums(spark, str(folder)).collect()}
    assert rows["rain.csv"]["checksum_sha256"] == hashlib.sha256(RAIN_CSV.encode()).hexdigest()
    assert rows["rain.csv"]["file_size_bytes"] == len(RAIN_CSV)


def test_text_files_are_made_in_one_folder_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file per hundred events whatever their bytes, none of them in a folder of its own, all read back whole."""
    import hashlib

    from talus.plans.catalog import load, sources

    for name, rows, schema in (
        ("orders", [(k, 1, "O" if k % 2 else None) for k in range(1, 1000, 3)] + [(205, 1, "F")], "o_orderkey long, o_custkey long, o_orderstatus string"),
        ("customer", [(1, 1)], "c_custkey long, c_nationkey long"), ("nation", [(1, "N")], "n_nationkey long, n_name string"),
    ):
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumns({"o_orderdate": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "o_orderpriority": F.lit("x")})
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(sources, "work_path", lambda spark, label: str(tmp_path / "made"))
    got = {r["doc"]: tuple(r)[1:] for r in load().queries["s09_text_checksums"](spark, str(tmp_path)).collect()}
    events = sorted([(k, "O" if k % 2 else "") for k in range(1, 1000, 3)] + [(205, "F")])
    want = {}
    for doc in range(10):
        body = (";".join(f"{k},{t}" for k, t in events if k // 100 == doc) + "\n").encode()
        want[doc] = (hashlib.sha256(body).hexdigest(), len(body))
    assert got == want
    made = [p.name for p in (tmp_path / "made").iterdir() if not p.name.startswith((".", "_"))]
    assert all(n.endswith(".txt") for n in made) and len({n[:10] for n in made}) > 2


def test_unknown_category_is_refused(spark):
    known = spark.createDataFrame([], "source_id string, category string, last_status string, last_error string, registered_at timestamp_ntz")
    new = spark.createDataFrame([("a", "music")], "source_id string, category string")
    with pytest.raises(Exception, match="unknown category music"):
        registry.register(known, new, F.current_timestamp().cast("timestamp_ntz")).collect()


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,latitude,longitude\nA,26,88\n")
    (tmp_path / "b.csv").write_text("lng,id,lat,severity\n89,B,27,high\n")
    (tmp_path / "c.csv").write_text("id,latitude,longitude\nC,28,90\n")
    rows = files.logical_view(files.read_csv(spark, str(tmp_path / "*.csv")))
    got = sorted((r.location_id, r.latitude, r.longitude, r.severity) for r in rows.collect())
    assert got == [("A", "26", "88", None), ("B", "27", "89", "high"), ("C", "28", "90", None)]


def test_boundaries_of_several_files_keep_apart(spark, tmp_path):
    for name, x in (("a", 0), ("b", 1)):
        ring = [[x, 0], [x + 2, 0], [x + 2, 2], [x, 2], [x, 0]]
        (tmp_path / f"{name}.geojson").write_text(
            '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"%s"},"geometry":'
            '{"type":"Polygon","coordinates":[%s]}}]}' % (name, ring))
    shapes = boundaries.read_polygons(spark, str(tmp_path / "*.geojson"))
    assert sorted((r.feature, r.name) for r in shapes.collect()) == [(0, "a"), (1, "b")]
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 1.0, 1.5), (3, 1.0, 2.5), (4, 1.0, 9.0)], "id long, latitude double, longitude double")
    got = {r.id: r.region for r in polygons.locate(points, shapes, "region").collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: None}
