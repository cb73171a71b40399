"""Alert state machine, operator actions, refresh stream, entry contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talus.operators import scoring
from talus.sources import weather
from talus.streaming import weather_refresh
from tests.test_expressions import ZONES, zone_table

AT = dt.datetime(2024, 5, 1)


def now():
    return F.lit(AT).cast("timestamp_ntz")


def empty_alerts(spark):
    return spark.createDataFrame([], weather_refresh.ALERT_COLUMNS)


def open_by_zone(alerts):
    return {r["zone_id"]: r["severity"] for r in alerts.where("is_active").collect()}


def test_alert_life_cycle(spark):
    scored = scoring.score_zones(zone_table(spark))
    first = scoring.reconcile(scored, empty_alerts(spark), now())
    want = {i: z[11] for i, z in enumerate(ZONES) if z[11] in ("HIGH", "CRITICAL")}
    assert open_by_zone(first) == want and len(want) == 4
    again = scoring.reconcile(scored, first, now())
    assert open_by_zone(again) == want and again.count() == 4
    calmer = scored.withColumn("risk_level", F.when(F.col("id") == 0, "HIGH").when(F.col("id") == 1, "LOW").otherwise(F.col("risk_level")))
    moved = scoring.reconcile(calmer, again, now())
    assert open_by_zone(moved) == {**{k: v for k, v in want.items() if k != 1}, 0: "HIGH"}
    closed = {r["zone_id"]: r["resolved_at"] for r in moved.where("NOT is_active").collect()}
    assert closed == {0: AT, 1: AT}


def test_messages(spark):
    rows = {r["zone_id"]: r for r in scoring.reconcile(scoring.score_zones(zone_table(spark)), empty_alerts(spark), now()).collect()}
    assert rows[0]["title"] == "LANDSLIDE WARNING - Darjeeling"
    assert rows[0]["message"] == ("Location: Darjeeling, S\nRisk Score: 85.02/100\nRisk Level: CRITICAL\n"
                                  "Primary contributing factor: Rainfall.")


def test_open_alert_of_same_level_protects_the_others(spark):
    alerts = spark.createDataFrame([(0, "t", "m", "CRITICAL", "active", True, 1.0, "r", AT, None), (0, "t", "m", "HIGH", "acknowledged", True, 1.0, "r", AT, None)],
                                   weather_refresh.ALERT_COLUMNS)
    scored = scoring.score_zones(zone_table(spark)).where("id = 0")
    assert scoring.decide(scored, alerts).first()["action"] == "keep"
    assert scoring.reconcile(scored, alerts, now()).where("is_active").count() == 2


def test_operator_actions(spark):
    alerts = spark.createDataFrame([(1, "active", True), (2, "resolved", False), (3, "active", True), (4, "active", True)], "id long, status string, is_active boolean")
    acts = [(1, "acknowledge", 1), (2, "acknowledge", 1), (3, "resolve", 1), (3, "acknowledge", 2), (4, "acknowledge", 1), (4, "resolve", 2), (4, "resolve", 3)]
    actions = spark.createDataFrame([(a, k, AT + dt.timedelta(days=n), n) for a, k, n in acts], "alert_id long, action string, at timestamp_ntz, seq int")
    got = {r["id"]: (r["status"], r["is_active"], r["acknowledged_at"] and (r["acknowledged_at"] - AT).days, r["resolved_at"] and (r["resolved_at"] - AT).days, r["refused"])
           for r in scoring.apply_actions(alerts, actions).collect()}
    assert got == {1: ("acknowledged", True, 1, None, 0), 2: ("resolved", False, None, None, 1), 3: ("resolved", False, None, 1, 1), 4: ("resolved", False, 1, 3, 0)}


def payload(i, zone, when, temperature=None, humidity=None, hours=(), mm=(), available=True):
    return (i, zone, when, available, (when.isoformat() if available else None, temperature, humidity), (list(hours), list(mm)))


def test_last_day_precipitation(spark):
    t = dt.datetime(2024, 5, 1, 12)
    hour = lambda n: (t - dt.timedelta(hours=n)).isoformat(timespec="minutes")
    hours, mm = [hour(25), hour(24), hour(3), hour(2), hour(-1)], [100.0, 1.5, None, 2.25, 50.0]
    rows = [payload(1, 1, t, hours=hours, mm=mm), payload(2, 1, t), (3, 1, t, True, (None, None, None), (hours, mm)), payload(4, 1, t, hours=[hour(1)], mm=[None])]
    df = spark.createDataFrame(rows, weather.PAYLOAD_SCHEMA)
    assert {r["payload_id"]: r["rainfall_24h"] for r in weather.readings(df).collect()} == {1: 3.75, 2: None, 3: 153.75, 4: None}


def test_refresh_stream(spark, tmp_path):
    tables = weather_refresh.RefreshTables(str(tmp_path / "state"))
    tables.start(zone_table(spark))
    t = dt.datetime(2024, 5, 1, 12)
    land = tmp_path / "land"

    def cycle(name, rows):
        spark.createDataFrame(rows, weather.PAYLOAD_SCHEMA).coalesce(1).write.json(str(land / name))
        weather_refresh.start(weather.stream_payloads(spark, f"{land}/*"), tables, str(tmp_path / "cp")).awaitTermination()
        return weather_refresh.latest_version(spark, tables)

    hour = t.isoformat(timespec="minutes")
    version = cycle("one", [payload(1, 4, t, 30.0, None, [hour], [200.0]), payload(2, 1, t, available=False)])
    assert version == 1
    zones = {r["id"]: r for r in tables.zones(spark, 1).collect()}
    assert (zones[4]["rainfall_24h"], zones[4]["temperature"], zones[4]["humidity"]) == (200.0, 30.0, 70.0)
    assert zones[1]["rainfall_24h"] == 120.0 and len(zones) == 7
    result = spark.read.parquet(tables.part("results", 0)).first()
    assert tuple(result) == (7, 1, 6, 7, 4)
    assert spark.read.parquet(tables.part("observations", 0)).count() == 1
    log = spark.read.parquet(tables.part("risk_log", 0))
    assert log.count() == 7 and log.where("inputs.rainfall_24h IS NULL").count() == 0
    version = cycle("two", [payload(3, 0, t, None, None, [hour], [0.0])])
    assert version == 2
    open_now = open_by_zone(tables.open_alerts(spark, 2))
    assert len(open_now) == tables.open_alerts(spark, 2).count()  # at most one per zone
    assert open_now[0] == "HIGH" and spark.read.parquet(tables.part("closed_alerts", 1)).count() == 1
    # running the batch again changes nothing
    before = sorted(map(str, tables.open_alerts(spark, 2).collect()))
    weather_refresh.refresh_batch(spark.read.schema(weather.PAYLOAD_SCHEMA).json(str(land / "two")), 1, tables)
    assert sorted(map(str, tables.open_alerts(spark, 2).collect())) == before
    # only zones that moved are written
    assert {r["id"] for r in spark.read.parquet(tables.part("zone_changes", 1)).collect()} == {0}


@pytest.mark.parametrize("compact_every", [2, 100])
def test_alerts_are_carried_resolved_and_raised_again(spark, tmp_path, compact_every):
    tables = weather_refresh.RefreshTables(str(tmp_path))
    tables.start(zone_table(spark))
    t = dt.datetime(2024, 5, 1, 12)
    rain = [{4: (200.0, 70.0)}, {4: (0.0, None), 1: (0.0, 0.0)}, {}, {1: (120.0, 88.0), 0: (0.0, 0.0)}, {0: (200.0, 99.0)}]
    history, states = [], []
    for n, wet in enumerate(rain):
        at = t + dt.timedelta(hours=n)
        rows = [payload(10 * n + z, z, at, None, humid, [at.isoformat(timespec="minutes")], [mm]) for z, (mm, humid) in wet.items()]
        rows += [payload(1000 + n, 6, at, available=False)]
        batch = spark.createDataFrame(rows, weather.PAYLOAD_SCHEMA)
        before = (sorted(map(str, tables.zones(spark, n).collect())), sorted(map(str, tables.open_alerts(spark, n).collect())))
        # A batch that was cut off before its commit does not count, and running it again gives the same.
        weather_refresh.refresh_batch(batch, n, tables, compact_every=compact_every)
        first = (sorted(map(str, tables.zones(spark, n + 1).collect())), sorted(map(str, tables.open_alerts(spark, n + 1).collect())))
        weather_refresh.refresh_batch(batch, n, tables, compact_every=compact_every)
        again = (sorted(map(str, tables.zones(spark, n + 1).collect())), sorted(map(str, tables.open_alerts(spark, n + 1).collect())))
        assert first == again and weather_refresh.latest_version(spark, tables) == n + 1
        assert before == (sorted(map(str, tables.zones(spark, n).collect())), sorted(map(str, tables.open_alerts(spark, n).collect())))
        history.append(open_by_zone(tables.open_alerts(spark, n + 1)))
        states.append({r["id"]: r["rainfall_24h"] for r in tables.zones(spark, n + 1).collect()})
        changed = {r["id"] for r in spark.read.parquet(tables.part("zone_changes", n)).collect()}
        assert n == 0 or changed <= set(wet)
    # The same by the batch form of the state machine, over snapshots.
    zones, alerts = zone_table(spark), empty_alerts(spark)
    for n, wet in enumerate(rain):
        new = spark.createDataFrame([(z, True, None, humid, mm) for z, (mm, humid) in wet.items()], "zone_id long, available boolean, temperature double, humidity double, rainfall_24h double")
        scored = scoring.score_zones(scoring.overlay_weather(zones, new)).checkpoint()
        alerts = scoring.reconcile(scored, alerts, now()).select(*alerts.columns).checkpoint()
        zones = scored.select(*zones.columns)
        assert history[n] == open_by_zone(alerts)
        assert states[n] == {r["id"]: r["rainfall_24h"] for r in zones.collect()}
    assert len({tuple(sorted(h.items())) for h in history}) >= 2


def test_entry_contract(spark):
    import __spark_entry__ as contract

    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140
    out = contract.entry(spark)
    assert out.count() == 1500 and "rainfall_30d" in out.columns


def test_refresh_reads_a_folder_of_part_files(spark, tmp_path):
    """The event table as one file and as a folder of parts gives the same zones."""
    from pathlib import Path

    from talus.plans.bindings import Domain
    from talus.plans.catalog import streams

    source = Path("/root/testdata/sf0.001")
    for f in source.iterdir():
        if f.name != "events.parquet":
            (tmp_path / f.name).symlink_to(f)
    spark.read.parquet(str(source / "events.parquet")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    one, parts = streams.t01(Domain(spark, str(source))), streams.t01(Domain(spark, str(tmp_path)))
    assert parts.where("temperature IS NOT NULL").count() > 0 and one.exceptAll(parts).count() == 0
