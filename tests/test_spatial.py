"""Grid joins, dense paths and windows against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from talus.functions import geo
from talus.operators import circle_counts, rainfall, raster, spatial
from talus.runtime import attach_to_groups, cut_lineage, positions, running_sums

R = 6371.0088


def dist(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("lat,lon", [(27.0, 88.0), (0.0, 179.95), (78.5, -179.9), (-64.0, 10.0), (89.6, 0.0)])
def test_radius_join_equals_brute_force(spark, lat, lon):
    rng = random.Random(7)
    wrap = lambda x: (x + 180) % 360 - 180
    spread = 1.0 if abs(lat) < 85 else 0.35
    place = lambda i: (i, min(90.0, lat + rng.uniform(-spread, spread)), wrap(lon + rng.uniform(-3, 3) / max(0.05, math.cos(math.radians(lat)))))
    a, b = [place(i) for i in range(60)], [place(i) for i in range(150)]
    got = {(r["id"], r["tid"]) for r in spatial.radius_pairs(
        spark.createDataFrame(a, "id long, latitude double, longitude double"),
        spark.createDataFrame(b, "tid long, latitude double, longitude double"), 40.0).collect()}
    want = {(p[0], t[0]) for p in a for t in b if dist(p[1], p[2], t[1], t[2]) <= 40.0}
    assert want and got == want


@pytest.mark.parametrize("leaf", [2, 16, 100000])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_k_nearest_equals_brute_force(spark, leaf, k):
    """A hot place of many copies, a crowded cluster off to one side, empty land, and the date line."""
    rng = random.Random(9)
    wrap = lambda x: (x + 180) % 360 - 180
    places = [(27.0, 179.9)] * 300 + [(27.3 + rng.gauss(0, 0.004), wrap(180.05 + rng.gauss(0, 0.004))) for _ in range(400)]
    places += [(26.5 + rng.random(), wrap(179.5 + rng.random())) for _ in range(60)] + [(None, 3.0)]
    targets = [(i, *p) for i, p in enumerate(places)]
    points = [(i, 26.6 + 0.9 * rng.random(), wrap(179.4 + 1.2 * rng.random())) for i in range(40)] + [(90, 27.0, 179.9), (91, -40.0, 3.0), (92, None, 1.0)]
    found = spatial.k_nearest(spark.createDataFrame(points, "point_id long, latitude double, longitude double"),
                              spark.createDataFrame(targets, "id long, latitude double, longitude double"), k, 30.0, leaf_rows=leaf)
    got = sorted((r["point_id"], r["rank"], r["id"]) for r in found.collect())
    want = []
    for p in points:
        if p[1] is not None:
            near = sorted((dist(p[1], p[2], t[1], t[2]), t[0]) for t in targets if t[1] is not None)
            want += [(p[0], n + 1, i) for n, (d, i) in enumerate([x for x in near if x[0] <= 30.0][:k])]
    assert got == sorted(want) and any(r[0] == 90 for r in got) and not any(r[0] == 91 for r in got)


def test_k_nearest_searches_once_per_place(spark, monkeypatch):
    """Many points in few places: the search meets places; a point with two places has the nearest targets of both."""
    asked = []
    search = spatial.search_cells
    monkeypatch.setattr(spatial, "search_cells", lambda df, *rest: asked.append(df.count()) or search(df, *rest))
    points = [(i, 27.0 + 0.1 * (i % 4), 88.0) for i in range(200)] + [(7, 27.0, 88.0)] * 2
    targets = [(i, 27.0 + 0.02 * i, 88.01) for i in range(20)]
    found = spatial.k_nearest(spark.createDataFrame(points, "point_id long, latitude double, longitude double"),
                              spark.createDataFrame(targets, "id long, latitude double, longitude double"), 3, 30.0).collect()
    want = []
    for i in range(200):
        places = {p[1:] for p in points if p[0] == i}
        near = sorted((dist(*p, t[1], t[2]), t[0]) for p in places for t in targets)
        want += [(i, n + 1, t) for n, (d, t) in enumerate([x for x in near if x[0] <= 30.0][:3])]
    assert sorted((r["point_id"], r["rank"], r["id"]) for r in found) == want
    assert asked == [4]


@pytest.mark.parametrize("dense_rows", [4, 50, 100000])
@pytest.mark.parametrize("cap", [1, 7, None])
def test_capped_counts_equal_brute_force(spark, dense_rows, cap):
    """One hot place with many copies, one dense cluster, and a sparse rest; every split level agrees."""
    rng = random.Random(3)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randint(0, 9600) * 6 % 9600)
    hot = [(27.0, 88.0, day()) for _ in range(700)]
    cloud = [(27.05 + rng.gauss(0, 0.02), 88.05 + rng.gauss(0, 0.02), day()) for _ in range(150)]
    rest = [(26.5 + rng.random(), 87.5 + rng.random(), day()) for _ in range(60)]
    targets = hot + cloud + rest
    points = [(i, 26.9 + rng.random() * 0.3, 87.9 + rng.random() * 0.3, day()) for i in range(40)]
    df = spark.createDataFrame(targets, "latitude double, longitude double, ts timestamp_ntz")
    seek = spark.createDataFrame(points, "point_id long, latitude double, longitude double, as_of timestamp_ntz")
    timed = {r["point_id"]: r["hits"] for r in spatial.count_within(seek, df, 10.0, cap, dense_rows).collect()}
    want = {p[0]: min(cap or 10 ** 9, sum(1 for t in targets if t[2] <= p[3] and dist(p[1], p[2], t[0], t[1]) <= 10.0)) for p in points}
    assert timed == {k: v for k, v in want.items() if v}
    plain = {r["point_id"]: r["hits"] for r in spatial.count_within(seek.drop("as_of"), df.drop("ts"), 10.0, cap, dense_rows).collect()}
    want = {p[0]: min(cap or 10 ** 9, sum(1 for t in targets if dist(p[1], p[2], t[0], t[1]) <= 10.0)) for p in points}
    assert plain == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("dense_rows", [4, 100000])
def test_dated_points_of_shared_places_are_counted_once_per_place(spark, dense_rows, monkeypatch):
    """Many points in six places, one id twice, one without a date; the circles are compared per place, not per point."""
    rng = random.Random(5)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 40))
    places = [(27.0 + rng.random() * 0.1, 88.0 + rng.random() * 0.1) for _ in range(6)]
    targets = [(*rng.choice(places), day()) for _ in range(200)] + [(27.05 + rng.gauss(0, 0.05), 88.05 + rng.gauss(0, 0.05), day()) for _ in range(100)]
    targets += [(27.0, 88.0, None), (None, 88.0, day())]
    points = [(i, *places[i % 6], day()) for i in range(120)] + [(3, *places[0], day()), (500, *places[1], None), (501, None, None, day())]
    compared = []
    original = spatial._compare_rows
    monkeypatch.setattr(spatial, "_compare_rows", lambda seekers, *rest: compared.append(seekers) or original(seekers, *rest))
    seek = spark.createDataFrame(points, "point_id long, latitude double, longitude double, as_of timestamp_ntz")
    df = spark.createDataFrame(targets, "latitude double, longitude double, ts timestamp_ntz")
    got = {r["point_id"]: r["hits"] for r in spatial.count_within(seek, df, 5.0, dense_rows=dense_rows).collect()}
    want = {}
    for i, lat, lon, as_of in points:
        if lat is not None and as_of is not None:
            want[i] = want.get(i, 0) + sum(1 for t in targets if t[0] and t[2] and t[2] <= as_of and dist(lat, lon, t[0], t[1]) <= 5.0)
    assert got == {k: v for k, v in want.items() if v}
    assert compared[0].select("latitude", "longitude", "_row", "_col").distinct().count() == compared[0].count()


@pytest.mark.parametrize("task_rows", [40, 100000])
@pytest.mark.parametrize("lat,lon", [(27.0, 88.0), (0.0, 179.95), (89.7, 0.0)])
def test_dated_circles_counted_in_tasks_equal_brute_force(spark, lat, lon, task_rows, monkeypatch):
    """Hot places with copies, the date line and the pole; a cell's points dealt over several tasks, crowded cells left to the subdivision."""
    monkeypatch.setattr(circle_counts, "GROUP_POINTS", 20)
    rng = random.Random(8)
    wrap = lambda x: (x + 180) % 360 - 180
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 40))
    place = lambda s: (min(90.0, lat + rng.gauss(0, s)), wrap(lon + rng.gauss(0, s) / max(0.01, math.cos(math.radians(lat)))))
    hot = [place(0.05) for _ in range(4)]
    targets = [(*rng.choice(hot), day()) for _ in range(200)] + [(*place(0.1), day()) for _ in range(300)] + [(lat, lon, None), (None, lon, day())]
    points = [(f"p{i}", *place(0.1), day()) for i in range(150)] + [("p3", *hot[0], day()), ("p3", *hot[0], day()), ("q", *hot[1], None), ("r", None, lon, day())]
    counted = []
    original = circle_counts.count_dated
    monkeypatch.setattr(circle_counts, "count_dated", lambda *given: counted.append(1) or original(*given))
    found = spatial.count_within(
        spark.createDataFrame(points, "point_id string, latitude double, longitude double, as_of timestamp_ntz"),
        spark.createDataFrame(targets, "latitude double, longitude double, ts timestamp_ntz"), 10.0, dense_rows=16, filled_rows=1, task_rows=task_rows)
    want = {}
    for i, y, x, as_of in points:
        if y is not None and as_of is not None:
            want[i] = want.get(i, 0) + sum(1 for t in targets if t[0] is not None and t[2] and t[2] <= as_of and dist(y, x, t[0], t[1]) <= 10.0)
    assert {r["point_id"]: r["hits"] for r in found.collect()} == {k: v for k, v in want.items() if v}
    assert counted


@pytest.mark.parametrize("lat,lon", [(27.0, 88.0), (0.0, 179.98), (89.9, 0.0)])
def test_nearby_targets_are_found_without_moving_the_points(spark, lat, lon):
    """The points were shuffled to the cells around them, and once more to their answers."""
    rng = random.Random(4)
    wrap = lambda x: (x + 180) % 360 - 180
    place = lambda: (min(90.0, lat + rng.gauss(0, 0.05)), wrap(lon + rng.gauss(0, 0.05) / max(0.01, math.cos(math.radians(lat)))))
    targets, points = [place() for _ in range(40)] + [(None, lon)], [(i, *place()) for i in range(200)] + [(900, None, lon), (901, lat, None)]
    seek = spark.createDataFrame(points, "id long, latitude double, longitude double")
    found = spatial.with_nearby(seek, spark.createDataFrame(targets, "latitude double, longitude double"), 2.0, "near")
    want = {i: None not in (y, x) and any(t[0] is not None and dist(y, x, *t) <= 2.0 for t in targets) for i, y, x in points}
    assert {r["id"]: r["near"] for r in found.collect()} == want and len(set(want.values())) == 2
    assert "ExistenceJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["id", "latitude", "longitude", "near"]


def stations(rng, n):
    return [(None if i % 4 == 0 else f"S{i % 9}", round(27 + rng.random() * 0.5, 4), round(88 + rng.random() * 0.5, 4)) for i in range(n)]


def readings(rng, sites, n):
    rows = []
    for _ in range(n):
        s = rng.choice(sites)
        when = None if rng.random() < 0.05 else dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 120), hours=rng.choice([0, 0, 7]))
        rows.append((*s, when, None if rng.random() < 0.1 else float(rng.randint(0, 60))))
    return rows + rows[:20]


def brute_summary(point, obs):
    _, lat, lon, as_of = point
    key = lambda o: o[0] or f"{round(o[1], 4)},{round(o[2], 4)}"
    near = [(dist(lat, lon, o[1], o[2]), key(o), o) for o in obs if o[3] and as_of - dt.timedelta(days=30) <= o[3] <= as_of]
    near = [x for x in near if x[0] <= 25.0]
    if not near:
        return None
    d, station, _ = min(near, key=lambda x: (x[0], x[1]))
    mine = [o for _, k, o in near if k == station]
    out = {}
    for name, days in {"rainfall_24h": 1, "rainfall_72h": 3, "rainfall_7d": 7, "rainfall_30d": 30}.items():
        inside = [o for o in mine if o[3] >= as_of - dt.timedelta(days=days)]
        out[name] = sum(o[4] or 0 for o in inside) if inside else None
        out[f"{name}_observation_count"] = len(inside)
    late = [o for o in mine if o[3] >= as_of - dt.timedelta(days=15)]
    out["antecedent_rainfall_index"] = sum((o[4] or 0) * 0.9 ** ((as_of - o[3]).total_seconds() / 86400) for o in late) if late else None
    return d, out


@pytest.mark.parametrize("crowded,most", [(2, 8191), (4096, 8191), (4096, 3), (2, 0)])
def test_rainfall_summary_equals_brute_force(spark, crowded, most):
    rng = random.Random(11)
    sites = stations(rng, 25)
    obs = readings(rng, sites, 500)
    points = [(i, 27 + rng.random() * 0.6, 88 + rng.random() * 0.6, dt.datetime(2020, 1, 10) + dt.timedelta(days=rng.randint(0, 150))) for i in range(40)]
    got = {r["point_id"]: r for r in rainfall.rainfall_summary(
        spark.createDataFrame(points, "point_id long, latitude double, longitude double, as_of timestamp_ntz"),
        spark.createDataFrame(obs, "station_id string, latitude double, longitude double, observed_date timestamp_ntz, rainfall_mm double"),
        crowded=crowded, most=most).collect()}
    assert len(got) == len(points)
    for p in points:
        want, row = brute_summary(p, obs), got[p[0]]
        if want is None:
            assert not row["rainfall_available"]
            continue
        assert row["nearest_station_distance_km"] == pytest.approx(want[0], abs=6e-4)
        for name, value in want[1].items():
            assert row[name] == (value if value is None else pytest.approx(value, abs=6e-3)), (p, name)
        sums = [row[w] or 0 for w in ("rainfall_24h", "rainfall_72h", "rainfall_7d", "rainfall_30d")]
        assert sums == sorted(sums)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strips_shuffle_the_readings_once(spark):
    obs = readings(random.Random(3), stations(random.Random(3), 9), 200)
    totals = cut_lineage(rainfall.instant_totals(spark.createDataFrame(
        obs, "station_id string, latitude double, longitude double, observed_date timestamp_ntz, rainfall_mm double")))
    assert plan_of(rainfall.strips(totals)).count("Exchange") == 1


@pytest.mark.parametrize("lists", [256, 2])
def test_stations_of_one_place_are_told_apart_by_their_readings(spark, lists, monkeypatch):
    """Many stations share few places: the nearest place that reports is chosen, and of its stations the lowest key that reports itself."""
    monkeypatch.setattr(rainfall, "LIST_STATIONS", lists)
    rng = random.Random(5)
    sites = [(f"S{i:02d}", 27 + (i % 4) * 0.05, 88.0) for i in range(40)]
    obs = [(*rng.choice(sites), dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 120)), 1.0) for _ in range(90)]
    points = [(i, 27 + rng.random() * 0.2, 88 + rng.random() * 0.1, dt.datetime(2020, 1, 10) + dt.timedelta(days=rng.randint(0, 130))) for i in range(60)]
    got = {r["point_id"]: r["station_key"] for r in rainfall.nearest_station(
        spark.createDataFrame(points, "point_id long, latitude double, longitude double, as_of timestamp_ntz"),
        spark.createDataFrame(obs, "station_id string, latitude double, longitude double, observed_date timestamp_ntz, rainfall_mm double"),
        crowded=2).collect()}
    for i, lat, lon, as_of in points:
        near = [(dist(lat, lon, o[1], o[2]), o[0]) for o in obs if as_of - dt.timedelta(days=30) <= o[3] <= as_of]
        assert got.get(i) == min((x for x in near if x[0] <= 25.0), default=(None, None))[1]


def test_lookback_readings_are_not_shuffled_after_the_join(spark):
    """Copies of a point count as often as they come; the rows that leave the join are the result."""
    points = [(1, 27.0, 88.0, dt.datetime(2020, 2, 1)), (1, 27.0, 88.0, dt.datetime(2020, 2, 1)), (2, 27.0, 88.0, dt.datetime(2020, 2, 2))]
    obs = [("A", 27.0, 88.0, dt.datetime(2020, 1, 20), 2.0), ("A", 27.0, 88.0, dt.datetime(2020, 1, 20), 3.0), ("A", 27.0, 88.0, dt.datetime(2020, 2, 2), None)]
    points = spark.createDataFrame(points, "point_id long, latitude double, longitude double, as_of timestamp_ntz")
    obs = spark.createDataFrame(obs, "station_id string, latitude double, longitude double, observed_date timestamp_ntz, rainfall_mm double")
    near = cut_lineage(points.select("point_id").distinct().withColumn("station_key", F.lit("A")))
    got = rainfall.lookback_readings(points, near, obs)
    plan = plan_of(got)
    assert "Aggregate" not in plan[:plan.index("Join")] and "Exchange" not in plan[:plan.index("Join")]
    assert sorted((r["point_id"], r["observed_date"].day, r["mm"], r["n"]) for r in got.collect()) == [(1, 20, 10.0, 4), (2, 2, 0.0, 1), (2, 20, 5.0, 2)]


def test_cells_without_a_target_are_dropped_before_the_shuffle(spark):
    points = spark.createDataFrame([(i, 27 + i / 50, 88.0) for i in range(50)], "point_id long, latitude double, longitude double")
    targets = spatial.target_cells(spark.createDataFrame([(27.1, 88.0), (27.1, 88.0), (27.5, 88.0)], "latitude double, longitude double"), 0.01)
    reach = spatial.search_cells(points, 1.0, 0.01)
    held = spatial.in_held_cells(reach, targets, ["_row", "_col"])
    cells = {tuple(r) for r in targets.select("_row", "_col").collect()}
    assert sorted(map(tuple, held.select("point_id", "_row", "_col").collect())) == sorted(
        tuple(r) for r in reach.select("point_id", "_row", "_col").collect() if (r["_row"], r["_col"]) in cells)
    assert 0 < held.count() < reach.count() / 10
    assert spatial.in_held_cells(reach, targets, ["_row", "_col"], limit=1).count() == reach.count()


def test_running_totals_of_many_readings(spark, tmp_path):
    """Every half hour for three months: windows are differences of running totals, exact to the last reading."""
    start = dt.datetime(2020, 1, 1)
    obs = [("S", 27.0, 88.0, start + dt.timedelta(minutes=30 * i), float(i % 7) / 4) for i in range(4400)]
    points = [(i, 27.01, 88.01, start + dt.timedelta(days=31 + 3 * i, minutes=30 * (i % 3))) for i in range(18)] + [(99, 27.0, 88.0, None)]
    readings = spark.createDataFrame(obs, "station_id string, latitude double, longitude double, observed_date timestamp_ntz, rainfall_mm double")
    got = rainfall.rainfall_summary(
        spark.createDataFrame(points, "point_id long, latitude double, longitude double, as_of timestamp_ntz"), readings)
    for r in got.collect():
        if r["as_of"] is None:
            assert not r["rainfall_available"] and r["rainfall_30d"] is None
            continue
        want = brute_summary((r["point_id"], 27.01, 88.01, r["as_of"]), obs)[1]
        for name, value in want.items():
            assert r[name] == pytest.approx(value, abs=6e-3), name
    readings.write.parquet(str(tmp_path / "readings"))
    again = rainfall.rainfall_summary(got.select("point_id", "latitude", "longitude", "as_of"), spark.read.parquet(str(tmp_path / "readings")))
    assert "readings" not in again._jdf.queryExecution().optimizedPlan().toString()      # read once, as stored totals


def test_entries_until(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 64, 8191):
        at = sorted(rng.sample(range(20_000), n))
        probes = [*rng.sample(range(-5, 20_010), 30), *at[:3], *at[-3:]]
        df = spark.createDataFrame([(x, [(a,) for a in at]) for x in probes], "x int, strip array<struct<at: int>>")
        for inclusive in (True, False):
            found = df.select("x", rainfall.entries_until(F.col("strip"), F.col("x"), inclusive).alias("k")).collect()
            assert all(r["k"] == sum(a <= r["x"] if inclusive else a < r["x"] for a in at) for r in found)


def dem(spark, geographic, value):
    cells = [(0, 0, r, c, float(value(r, c))) for r in range(10) for c in range(10)]
    df = spark.createDataFrame(cells, "tile_lat int, tile_lon int, row int, col int, value double")
    return df, raster.summarize(df, 0.1, -9999.0, geographic)


def test_slope_of_an_even_ramp(spark):
    """Rising 15 m per row southward on 30 m cells: 26.565 degrees, facing north."""
    from talus.functions import terrain

    cells, _ = dem(spark, False, lambda r, c: 2000 + 15 * r)
    blocks = raster.neighbourhoods(cells, cells)
    block = {o: F.col(f"z{o[0] + 1}{o[1] + 1}") for o in raster.OFFSETS}
    slope, aspect = terrain.horn(block, F.lit(30.0), F.lit(30.0))
    inner = blocks.where("n = 9").select(slope.alias("s"), aspect.alias("a")).distinct().collect()
    assert [(r["s"], r["a"]) for r in inner] == [(26.565, 0.0)]
    assert blocks.where("n < 9").count() == 36


def test_blocks_of_a_whole_raster(spark):
    """Tiles larger than a patch, gaps, copies and keys that are missing; no block is shuffled as nine rows."""
    rng = random.Random(5)
    cells = [(t, 0, r, c, None if rng.random() < 0.02 else float(rng.randint(0, 99))) for t in (0, 1) for r in range(70) for c in range(60, 130) if rng.random() < 0.95]
    cells += rng.sample(cells, 40) + [(0, 0, None, 3, 1.0), (None, 0, 5, 70, 1.0)]
    df = spark.createDataFrame(cells, "tile_lat int, tile_lon int, row int, col int, value double")
    held = {}
    for *pixel, v in cells:
        held.setdefault(tuple(pixel), []).append(v)
    want = {}
    for t, u, r, c in held:
        if None not in (t, u, r, c):
            near = [held.get((t, u, r + dr, c + dc), []) for dr, dc in raster.OFFSETS]
            want[t, u, r, c] = (*[max((v for v in vs if v is not None), default=None) for vs in near], sum(map(len, near)))
    blocks = raster.neighbourhoods(df, df)
    assert {tuple(x[:4]): tuple(x[4:]) for x in blocks.collect()} == want
    plan = blocks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_terrain_at_edges_flat_ground_and_nodata(spark):
    cells, tiles = dem(spark, True, lambda r, c: -9999 if (r, c) == (5, 5) else 100)
    points = spark.createDataFrame([("inner", 0.75, 0.25), ("edge", 0.95, 0.95), ("nodata", 0.45, 0.55), ("beside", 0.35, 0.55), ("out", 3.0, 3.0)],
                                   "k string, latitude double, longitude double")
    got = {r["k"]: r[3:] for r in raster.terrain_features(points, cells, tiles).collect()}
    assert got["inner"] == (100.0, 0.0, None, True)
    assert got["edge"] == (100.0, None, None, True)
    assert got["nodata"] == (None, None, None, False) and got["out"] == (None, None, None, False)
    assert got["beside"][0] == 100.0 and got["beside"][1] > 0  # only the centre is tested for nodata


def test_slope_across_seams(spark):
    """Four tiles of one sloping plane: the seams have the slope of the inside, the outer edge has none."""
    cells = [(tlat, tlon, r, c, float(100 * ((1 - tlat) * 10 + r))) for tlat in (0, 1) for tlon in (0, 1) for r in range(10) for c in range(10)]
    cells = spark.createDataFrame(cells, "tile_lat int, tile_lon int, row int, col int, value double")
    tiles = raster.summarize(cells, 0.1, -9999.0)
    points = spark.createDataFrame([(1, 1.05, 0.95), (2, 0.95, 1.05), (3, 1.55, 1.05), (4, 1.95, 1.05), (5, 0.55, 0.05)],
                                   "id long, latitude double, longitude double")
    got = {r.id: r.slope_degrees for r in raster.terrain_features(points, cells, tiles).collect()}
    assert got[1] and got[2] and got[3] and got[4] is None and got[5] is None
    own = {r.id: r.slope_degrees for r in raster.terrain_features(points, cells, tiles, across=False).collect()}
    assert own == {1: None, 2: None, 3: None, 4: None, 5: None}
    plan = raster.terrain_features(points, cells, tiles)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_positions_and_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc") if rng.random() < 0.9 else None, i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    assert {(r["k"], r["position"]) for r in positions(df, [F.col("k")]).collect()} == {(k, k + 1) for k in range(500)}
    want = {}
    for g, k, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[k] = 1 + sum(1 for x in rows if x[0] == g and x[1] < k)
    assert {r["k"]: r["position"] for r in positions(df, [F.col("k")], ["g"]).collect()} == want
    by_key = {k: v for _, k, v in rows}
    sums = {r["k"]: r["s"] for r in running_sums(df, [F.col("k").desc()], {"s": "v"}).collect()}
    assert sums == {k: sum(v for j, v in by_key.items() if j >= k) for k in by_key}


def test_hot_key_is_split_by_adaptive_execution(spark):
    """One key holds most rows: the lookup join must not leave them in one task."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 800_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.xxhash64("id").alias("x"))
        groups = rows.groupBy("k").agg(F.count("*").alias("n"))
        joined = attach_to_groups(rows, groups, ["k"])
        counted = {r["k"]: r["n"] for r in joined.where("k = -1 OR k = 3").select("k", "n").distinct().collect()}
        assert counted == {-1: rows.where("k = -1").count(), 3: 1}
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_circle_box_holds_the_circle(spark):
    """Every place within the radius is in the box, at the date line and near a pole too; far places are not."""
    places = [(lat / 2, lon / 2) for lat in range(-180, 181, 3) for lon in range(-360, 361, 3)]
    df = spark.createDataFrame(places, "latitude double, longitude double")
    for lat, lon, radius in ((27.0, 88.5, 300.0), (10.0, 179.6, 400.0), (-60.0, -179.9, 700.0), (88.0, 20.0, 500.0), (85.0, -170.0, 200.0)):
        near = geo.haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")) <= radius
        boxed = geo.circle_box(F.col("latitude"), F.col("longitude"), lat, lon, radius)
        r = df.agg(F.count_if(near).alias("near"), F.count_if(near & boxed).alias("held"), F.count_if(boxed).alias("boxed")).first()
        assert 0 < r["near"] == r["held"] <= r["boxed"] < len(places) / 10
