"""Scalar semantics against hand-computed values."""

import datetime as dt

from pyspark.sql import functions as F

from talus import vocab
from talus.functions import quality, risk, terrain, text
from talus.operators import scoring


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_numbers(spark):
    given = ["1.5", " 7 ", "1e3", "1_000", "-.5", "5.", "1d", "2f", "0x10", "abc", "", None, "inf", "NaN"]
    got = values(spark, [(g,) for g in given], "t string", text.to_double(F.col("t")))
    assert got[:6] == [1.5, 7.0, 1000.0, 1000.0, -0.5, 5.0]
    assert got[6:12] == [None] * 6
    assert got[12] == float("inf") and got[13] != got[13]


def test_dates(spark):
    cases = {
        "2023-07-12": dt.datetime(2023, 7, 12),
        "2023-07-12T08:30:15": dt.datetime(2023, 7, 12, 8, 30, 15),
        "2023-07-12 08:30": dt.datetime(2023, 7, 12, 8, 30),
        "2023-07-12T08": dt.datetime(2023, 7, 12, 8),
        "2023-07-12T08:30:15.25": dt.datetime(2023, 7, 12, 8, 30, 15, 250000),
        "2023-07-12T08:30:00+05:30": dt.datetime(2023, 7, 12, 3, 0),
        "2023-7-2": dt.datetime(2023, 7, 2),
        "2023/07/12": dt.datetime(2023, 7, 12),
        "12-07-2023": dt.datetime(2023, 7, 12),
        "07/12/2023": dt.datetime(2023, 12, 7),
        "07/25/2023": dt.datetime(2023, 7, 25),
        "20230712": dt.datetime(2023, 7, 12),
        "20230712T101112": dt.datetime(2023, 7, 12, 10, 11, 12),
        "20230712T1011": dt.datetime(2023, 7, 12, 10, 11),
        "20230712 101112.5+0530": dt.datetime(2023, 7, 12, 4, 41, 12, 500000),
        "2023-07-12T101112": dt.datetime(2023, 7, 12, 10, 11, 12),
        "2023-07-12T08:30:15.123456789": dt.datetime(2023, 7, 12, 8, 30, 15, 123456),
        "2023-07-12T1011:12": None, "2023-07-12T10:1112": None,
        "07/12/2023 01:05:09 PM": dt.datetime(2023, 7, 12, 13, 5, 9),
        "07/12/2023 13:05:09": dt.datetime(2023, 7, 12, 13, 5, 9),
        "2023": None, "2023-02-30": None, "nan": None, "None": None, "": None, "soon": None,
    }
    got = values(spark, [(k,) for k in cases], "t string", text.parse_date(F.col("t")))
    assert dict(zip(cases, got)) == cases


def test_coordinate_errors(spark):
    rows = [(90.0, 180.0), (90.1, 0.0), (0.0, -180.5), (None, 1.0), (float("nan"), 0.0), (99.0, 200.0)]
    got = values(spark, rows, "a double, b double", quality.coordinate_errors(F.col("a"), F.col("b")))
    assert got == [[], ["invalid_latitude"], ["invalid_longitude"], ["missing_coordinates"], ["invalid_latitude"],
                   ["invalid_latitude", "invalid_longitude"]]


def test_record_completeness(spark):
    fields = ["latitude", "longitude", "rainfall_24h", "rainfall_7d", "humidity", "temperature", "slope", "elevation", "vegetation"]
    df = spark.createDataFrame([(1.0, 2.0, None, None, 5.0, None, None, None, None, True, "2020-01-01"),
                                (1.0, None, None, None, None, None, None, 3.0, None, None, None)],
                               ", ".join(f"{f} double" for f in fields) + ", historical_landslide boolean, event_date string")
    score, missing = quality.record_completeness({c: F.col(c) for c in df.columns})
    got = [tuple(r) for r in df.select(score, missing).collect()]
    assert got[0] == (80, ["rainfall_24h", "rainfall_7d", "temperature", "slope", "elevation", "vegetation"])
    assert got[1] == (20, ["longitude", "rainfall_24h", "rainfall_7d", "humidity", "temperature", "slope", "vegetation",
                           "historical_landslide", "event_date"])


ZONES = [
    # name, rain24, rain7, humidity, temperature, slope, elevation, vegetation, historical, factors, score, level
    ("Darjeeling", 180.0, 650.0, 94.0, 18.0, 42.0, 2050.0, 0.25, True, [31.87, 17.5, 11.25, 15.0, 9.4], 85.02, "CRITICAL"),
    ("Gangtok", 120.0, 500.0, 88.0, 17.0, 38.0, 1650.0, 0.35, True, [22.49, 15.83, 9.75, 15.0, 8.8], 71.87, "HIGH"),
    ("Kalimpong", 70.0, 300.0, 75.0, 20.0, 30.0, 1250.0, 0.5, False, [13.27, 12.5, 7.5, 0.0, 7.5], 40.77, "MODERATE"),
    ("Shillong", 140.0, 550.0, 85.0, 19.0, 25.0, 1500.0, 0.45, False, [25.61, 10.42, 8.25, 0.0, 8.5], 52.78, "HIGH"),
    ("Guwahati", 40.0, 150.0, 70.0, 28.0, 8.0, 55.0, 0.6, False, [7.19, 3.33, 6.0, 0.0, 7.0], 23.52, "LOW"),
    ("Aizawl", 90.0, 380.0, 80.0, 22.0, 33.0, 1130.0, 0.55, False, [16.96, 13.75, 6.75, 0.0, 8.0], 45.46, "MODERATE"),
    ("Itanagar", 130.0, 420.0, 82.0, 21.0, 55.0, 440.0, 0.3, True, [22.1, 22.92, 10.5, 15.0, 8.2], 78.72, "CRITICAL"),
]


def zone_table(spark):
    rows = [(i, z[0], "S", *z[1:9], "demo_seed", False, 0.0, "UNKNOWN", None) for i, z in enumerate(ZONES)]
    return spark.createDataFrame(
        rows, "id long, name string, state string, rainfall_24h double, rainfall_7d double, humidity double, temperature double, "
              "slope double, elevation double, vegetation double, historical_landslide boolean, source_type string, "
              "terrain_data_real boolean, risk_score double, risk_level string, updated_at timestamp_ntz")


def test_reference_zone_scores(spark):
    scored = {r["name"]: r for r in scoring.score_zones(zone_table(spark)).collect()}
    for z in ZONES:
        row = scored[z[0]]
        assert [row[f"factor_{f}"] for f in vocab.FACTORS] == z[9]
        assert (row["risk_score"], row["risk_level"]) == (z[10], z[11])


def test_guarded_zone_keeps_its_score(spark):
    derived = zone_table(spark).withColumn("source_type", F.lit("derived"))
    for row in scoring.score_zones(derived).collect():
        assert (row["risk_score"], row["risk_level"], row["prediction_source"]) == (0.0, "UNKNOWN", vocab.GUARDED_SOURCE)
        assert all(row[f"factor_{f}"] == 0.0 for f in vocab.FACTORS)


def test_levels_and_top_factor(spark):
    got = values(spark, [(25.0,), (25.01,), (50.0,), (75.0,), (75.01,), (None,)], "s double", risk.level(F.col("s")))
    assert got == ["LOW", "MODERATE", "MODERATE", "HIGH", "CRITICAL", None]
    factors = {n: F.lit(v) for n, v in zip(vocab.FACTORS, [3.0, 15.0, 2.0, 15.0, 1.0])}
    assert spark.range(1).select(risk.top_factor_reason(factors)).first()[0] == "Primary contributing factor: Slope."


def test_score_from_probabilities(spark):
    p = F.array(F.lit(0.02), F.lit(0.08), F.lit(0.70), F.lit(0.20))
    assert spark.range(1).select(risk.score_from_probabilities(p, vocab.RISK_LEVELS)).first()[0] == 64.5


def test_landcover_and_aspect(spark):
    got = values(spark, [(10,), (40,), (80,), (77,), (None,)], "c int", terrain.landcover_category(F.col("c"), "esa_worldcover"))
    assert got == ["forest", "cropland", "water", "unknown", "unknown"]
    sin, cos = terrain.aspect_parts(F.col("a"))
    rows = spark.createDataFrame([(0.0,), (90.0,), (None,)], "a double").select(sin, cos).collect()
    assert [tuple(r) for r in rows] == [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def test_question_routing(spark):
    cases = {"Which zone has the highest risk?": "riskiest_place", "how many alerts are active": "alerts", "is it raining? rain in X": "weather_lookup",
             "How many landslides in Sikkim?": "state_event_count", "Is Gangtok safe": "place_lookup", "hello": "unrecognized", "  ": "help"}
    got = values(spark, [(k,) for k in cases], "q string", text.route_intent(F.col("q")))
    assert dict(zip(cases, got)) == cases
