"""Question matching, row numbers without a sort, inspection, the dataset job."""

import json
import random

from pyspark.sql import functions as F

from talus.functions.text import parse_iso
from talus.operators import sampling
from talus.plans import assistant, ingestion
from talus.plans.bindings import Domain
from talus.plans.catalog import features as catalog
from talus.plans.catalog import streams
from talus.runtime import spread
from talus.sources import files, weather


def test_names_in_long_questions_equal_substring_search(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdé -") for _ in range(n))
    names = [(i, word(r.choice([1, 2, 5, 8, 9, 14])) + r.choice(["", " (Historical Cluster)"]), r.choice(["Sikkim", "Assam", "", None])) for i in range(120)]
    names += [(500, "Customer#000000001", "S"), (501, "Customer#000000012", "S"), (502, "customer#000000012", "T")]
    questions = [(i, word(r.choice([0, 3, 30, 400]))) for i in range(60)] + [(90, None), (91, "")]
    questions += [(100, "x" * 4000 + " what of CUSTOMER#0000000123 and sikkimese " + word(6000)), (101, "rain in customer#000000001?"), (102, "rain in customer#000000001?")]
    zones = spark.createDataFrame(names, "id long, name string, state string")
    got = {q.question_id: q.zone_id for q in assistant.match_zones(spark.createDataFrame(questions, "question_id long, question string"), zones).collect()}
    for i, q in questions:
        found = [(len(t), z) for z, n, s in names for t in (n.replace(" (Historical Cluster)", ""), s) if t and q is not None and t.lower() in q.lower()]
        assert got.get(i) == (max(found)[1] if found else None), (i, q)
    assert got[100] == 502 and got[101] == got[102] == 500


def test_rows_of_a_question_grow_with_its_length(spark):
    names = spark.createDataFrame([(i, f"Customer#{i:09d}", "Somewhere") for i in range(2000)], "id long, name string, state string")
    index = assistant.anchors(assistant.place_names(names))
    per_gram = index.groupBy("gram").count().agg(F.max("count")).first()[0]
    assert index.count() == 2001 and per_gram <= 40     # no piece stands for more than a few names


def test_numbers_follow_the_files(spark, tmp_path):
    for k, n in (("a", 700), ("b", 1), ("c", 900)):
        (tmp_path / f"{k}.csv").write_text("id,lat\n" + "".join(f"{k}{i},{'1' * 40}\n" for i in range(n)))
    want = [f"a{i}" for i in range(700)] + ["b0"] + [f"c{i}" for i in range(900)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "4096"):        # one split per file, and many
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = ingestion.numbered(files.read_csv(spark, str(tmp_path / "*.csv")))
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan
            assert [r.id for r in sorted(rows.collect(), key=lambda r: r["index"])] == want
            assert sorted(r["index"] for r in rows.repartition(3).collect()) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranked_inventory_rows_are_read_again_by_column(spark):
    """Ranked rows were checkpointed one by one, and every later step read all their texts."""
    texts = [F.concat(F.lit(f"text {i}, "), (F.col("id") % 9).cast("string")).alias(f"text_{i}") for i in range(10)]
    rows = ingestion.numbered(spark.range(3000).select(*texts, F.struct((-F.col("id")).alias("row_key")).alias("_order")))
    assert "text_5" not in rows.select("index")._jdf.queryExecution().executedPlan().toString()
    assert rows.where(F.col("index") != F.col("_order.row_key") + 2999).count() == 0 and rows.select("index").distinct().count() == 3000


def test_inspection(spark, tmp_path):
    (tmp_path / "e.csv").write_text('Latitude,lng,Date,note\n10,20,2020-01-01,"a\nb"\nx,30,,\n12,25,2020-01-02,c\n11,,2020-01-02,\n')
    seen = ingestion.inspect_file(spark, str(tmp_path / "e.csv")).first()
    assert (seen.file_type, seen.geometry_type, seen.records, seen["columns"]) == ("csv", None, 4, ["Latitude", "lng", "Date", "note"])
    assert (seen.latitude_column, seen.longitude_column, seen.date_column) == ("Latitude", "lng", "Date")
    assert seen.missing_cells == {"Date": 1, "lng": 1, "note": 2}
    assert [json.loads(x)["Latitude"] for x in seen.sample_rows] == ["10", "x", "12"] and json.loads(seen.sample_rows[0])["note"] == "a\nb"
    assert (seen.min_latitude, seen.max_latitude, seen.min_longitude, seen.max_longitude) == (10.0, 12.0, 20.0, 25.0)
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "x"}, "geometry": None},
                                                      {"type": "Feature", "properties": {"name": "y"}, "geometry": {"type": "Point", "coordinates": [5, 6]}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(doc))
    seen = ingestion.inspect_file(spark, str(tmp_path / "p.geojson")).first()
    assert (seen.file_type, seen.geometry_type, seen.records, seen.latitude_column) == ("geojson", "Point", 2, "latitude")


def test_dataset_job_and_its_report(spark):
    built = catalog.dataset(Domain(spark, "/root/testdata/sf0.001"))
    said = built.sampling.first()
    assert said.requested == said.accepted + said.short_by and said.attempts == sum(said[o] for o in sampling.OUTCOMES)
    assert built.negatives.count() == said.accepted
    meta = built.metadata.first()
    counts = {r.label: r["count"] for r in built.rows.groupBy("label").count().collect()}
    assert (counts.get(1, 0), counts.get(0, 0)) == (meta.positive_count, meta.negative_count)
    assert meta.positive_count + meta.negative_count + meta.rows_dropped_missing_features == said.requested + said.accepted


def test_shortfall_is_reported(spark):
    stats = spark.createDataFrame([("accepted", 3), ("buffer", 10)], "outcome string, attempts long")
    said = sampling.report(stats, 8).first()
    assert (said.requested, said.short_by, said.attempts, said.accepted, said.buffer, said.no_terrain) == (8, 5, 13, 3, 10, 0)
    none = sampling.report(stats.limit(0), 2).first()
    assert (none.short_by, none.attempts) == (2, 0)


def test_a_drop_is_written_by_many_tasks_in_order(spark):
    """The file of a drop was sorted and written by one task."""
    keys = [(i * 7919) % 3001 for i in range(3000)]
    raw = spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.struct(F.col("k").alias("row_key")).alias("_order"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = streams.dropped(raw, 1).select("k").rdd.map(lambda r: r["k"]).glom().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(bool(p) for p in parts) > 1
    assert [k for p in parts for k in p] == sorted(k for k in keys if k % 3 == 1)


def test_rows_of_one_split_are_dealt_over_all_tasks_though_others_are_empty(spark):
    rows = spark.range(0, 1600, 1, 1).unionByName(spark.range(0, 0, 1, 20))
    sizes = spread(rows).rdd.glom().map(len).collect()
    assert sum(sizes) == 1600 and max(sizes) <= 100


def test_the_reference_of_a_day_is_parsed_once_per_payload(spark):
    """Sums by hand: future, too old, NULL and unreadable samples; without a reference every sample counts."""
    times = ["2024-05-01T00:00", "2024-05-01T12:00", "2024-05-02T00:00", "2024-05-02T06:00", "soon"]
    rows = [(1, "2024-05-02T00:00", (times, [1.0, 2.0, 4.0, 8.0, 16.0])), (2, None, (times, [1.0, None, 4.0, 8.0, 16.0])),
            (3, "2024-05-02T00:00", ([], [])), (4, "2024-04-01T00:00", (times, [1.0] * 5)), (5, "2024-05-02T00:00", None)]
    df = spark.createDataFrame(rows, "id long, ref string, hourly struct<time: array<string>, precipitation: array<double>>")
    out = df.select("id", weather.last_day_precipitation(F.col("hourly"), F.col("ref")).alias("mm"))
    assert {r["id"]: r["mm"] for r in out.collect()} == {1: 7.0, 2: 13.0, 3: None, 4: None, 5: None}
    seen = lambda d: d._jdf.queryExecution().analyzed().toString().count("ref#")
    assert seen(out) == seen(df.select("id", parse_iso(F.col("ref"))))
