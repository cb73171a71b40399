"""Pages, viewports, ranked lists, histories, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import geo
from talus.operators import scoring, spatial, summaries
from talus.plans import assistant
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.fragments import d, detail_view, hav
from talus.sources import registry

query = CATALOG.query


@query("l01_event_page", """SELECT id, state, source_id, event_date, created_at, (SELECT count(*) FROM haz WHERE source_id = 'src_20') AS total,
    (SELECT greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) FROM haz WHERE source_id = 'src_20') AS total_pages
    FROM haz WHERE source_id = 'src_20' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100""")
def l01(dom: Domain):
    rows = spatial.common_filters(dom.events, "event_date", "src_20")
    return summaries.page(rows, [F.col("created_at").desc(), F.col("id")], 3, 50).select(
        "id", "state", "source_id", "event_date", "created_at", "total", "total_pages")


@query("l02_rainfall_page", """SELECT source_record_id, station_id, observed_date, rainfall_mm, (SELECT count(*) FROM rain) AS total,
    (SELECT CAST(ceil(count(*) / 200.0) AS BIGINT) FROM rain) AS total_pages FROM rain
    ORDER BY observed_date DESC NULLS LAST, source_record_id, rainfall_mm NULLS FIRST, station_id NULLS FIRST LIMIT 200 OFFSET 200""")
def l02(dom: Domain):
    order = [F.col("observed_date").desc_nulls_last(), "source_record_id", "rainfall_mm", "station_id"]
    return summaries.page(dom.rainfall, order, 2, 200).select("source_record_id", "station_id", "observed_date", "rainfall_mm", "total", "total_pages")


BOX = f"latitude BETWEEN {d(26.4)} AND {d(27.6)} AND longitude BETWEEN {d(88.3)} AND {d(89.5)}"


@query("l03_event_viewport", f"""SELECT id, latitude, longitude, event_date, (SELECT count(*) FROM haz WHERE {BOX}) AS total_matching,
    (SELECT count(*) > 500 FROM haz WHERE {BOX}) AS truncated FROM haz WHERE {BOX} ORDER BY event_date DESC NULLS LAST, id LIMIT 500""")
def l03(dom: Domain):
    return spatial.in_box(dom.events, (26.4, 88.3, 27.6, 89.5), 500, "event_date", ["id"]).select(
        "id", "latitude", "longitude", "event_date", "total_matching", "truncated")


@query("l03_rainfall_viewport", f"""SELECT source_record_id, observed_date, rainfall_mm, (SELECT count(*) FROM rain WHERE {BOX}) AS total_matching,
    (SELECT count(*) > 500 FROM rain WHERE {BOX}) AS truncated FROM rain WHERE {BOX}
    ORDER BY observed_date DESC NULLS LAST, source_record_id, rainfall_mm NULLS FIRST, station_id NULLS FIRST LIMIT 500""")
def l03r(dom: Domain):
    return spatial.in_box(dom.rainfall, (26.4, 88.3, 27.6, 89.5), 500, "observed_date", ["source_record_id", "rainfall_mm", "station_id"]).select(
        "source_record_id", "observed_date", "rainfall_mm", "total_matching", "truncated")


@query("l04_station_history", """SELECT source_record_id, observed_date, rainfall_mm FROM rain WHERE station_id = 'ST1'
    ORDER BY observed_date ASC NULLS LAST, source_record_id, rainfall_mm NULLS FIRST LIMIT 200""")
def l04(dom: Domain):
    return summaries.station_history(dom.rainfall, "ST1", 200, ["source_record_id", "rainfall_mm"]).select("source_record_id", "observed_date", "rainfall_mm")


@query("l04_nearest_station_history", """SELECT source_record_id, observed_date, rainfall_mm FROM near, s WHERE CASE WHEN sid IS NOT NULL THEN station_id = sid ELSE latitude = sy AND longitude = sx END
    ORDER BY observed_date ASC NULLS FIRST, source_record_id, rainfall_mm NULLS FIRST LIMIT 200""",
       near=f"SELECT * FROM (SELECT *, {hav(d(26.9), d(88.75), 'latitude', 'longitude')} AS dist FROM rain) WHERE dist <= 25",
       s="SELECT station_id AS sid, latitude AS sy, longitude AS sx FROM near ORDER BY dist, source_record_id, rainfall_mm NULLS FIRST LIMIT 1")
def l04n(dom: Domain):
    distance = geo.haversine_km(F.lit(26.9), F.lit(88.75), F.col("latitude"), F.col("longitude"))
    boxed = dom.rainfall.where(geo.circle_box(F.col("latitude"), F.col("longitude"), 26.9, 88.75, 25))
    pairs = boxed.withColumn("distance_km", distance).where(F.col("distance_km") <= 25)
    return summaries.nearest_station_history(pairs, 200, ["source_record_id", "rainfall_mm"]).select("source_record_id", "observed_date", "rainfall_mm")


RANK = "CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END"


@query("l05_zones_by_risk", f"SELECT id, risk_level, risk_score FROM zones ORDER BY {RANK}, risk_score DESC, id")
def l05(dom: Domain):
    return summaries.sorted_by_risk(dom.zones).select("id", "risk_level", "risk_score")


@query("l05_high_risk_zones", f"SELECT id, risk_level, risk_score FROM zones WHERE risk_level IN ('HIGH', 'CRITICAL') ORDER BY {RANK}, risk_score DESC, id")
def l05h(dom: Domain):
    return summaries.high_risk(dom.zones).select("id", "risk_level", "risk_score")


@query("l06_riskiest_zones", "SELECT id, name, risk_score FROM zones WHERE risk_level <> 'UNKNOWN' ORDER BY risk_score DESC, id LIMIT 3")
def l06(dom: Domain):
    return summaries.riskiest(dom.zones).select("id", "name", "risk_score")


@query("l07_active_alerts", "SELECT id, zone_id, status, created_at FROM alerts WHERE is_active ORDER BY created_at DESC, id DESC")
def l07(dom: Domain):
    return summaries.alerts_with_status(dom.alerts, "active").select("id", "zone_id", "status", "created_at")


@query("l07_recent_alerts", "SELECT id, zone_id, status, created_at FROM alerts ORDER BY created_at DESC, id DESC LIMIT 4")
def l07r(dom: Domain):
    return summaries.alerts_with_status(dom.alerts, "all").limit(4).select("id", "zone_id", "status", "created_at")


@query("l08_regions", "SELECT id, name, state FROM regions WHERE source_type = 'derived'")
def l08(dom: Domain):
    return dom.regions.where("source_type = 'derived'").select("id", "name", "state")


@query("l09_sources_by_category", "SELECT source_id, name FROM sources WHERE category = 'rainfall' ORDER BY source_id")
def l09(dom: Domain):
    return dom.sources.where("category = 'rainfall'").orderBy("source_id").select("source_id", "name")


@query("l10_zone_details", """SELECT id, name, state, risk_score, risk_level, source_type, historical_event_count, updated_at, rainfall_24h, slope, vegetation,
    CASE WHEN guarded THEN 0 ELSE f_slope END AS factor_slope, CASE WHEN guarded THEN 0 ELSE f_rainfall END AS factor_rainfall FROM detail ORDER BY id""",
       detail=detail_view())
def l10(dom: Domain):
    return scoring.zone_detail(dom.zones).orderBy("id").select(
        "id", "name", "state", "risk_score", "risk_level", "source_type", "historical_event_count", "updated_at", "rainfall_24h", "slope", "vegetation",
        "factor_slope", "factor_rainfall")


@query("p36_visible_zones", """SELECT id, name, state FROM zones z WHERE risk_level = 'HIGH' AND contains(lower(name || ' ' || state), 'nation_1')
    AND EXISTS (SELECT 1 FROM alerts a WHERE a.zone_id = z.id AND a.is_active)""")
def p36(dom: Domain):
    return summaries.visible_zones(dom.zones, dom.alerts, level="HIGH", alerts_only=True, search=" Nation_1 ").select("id", "name", "state")


HISTORY = "SELECT payload_id AS id, zone_id, received_at AS created_at, cur_time AS observed_at, temperature FROM payloads WHERE available"


def history(dom: Domain):
    return dom.payloads.where("available").select(
        F.col("payload_id").alias("id"), "zone_id", F.col("received_at").alias("created_at"),
        F.col("current.time").cast("timestamp_ntz").alias("observed_at"), F.col("current.temperature_2m").alias("temperature"))


@query("w03_newest_per_zone", "SELECT id, zone_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY created_at DESC, id DESC) AS rn FROM hist) WHERE rn <= 20",
       hist=HISTORY)
def w03(dom: Domain):
    return summaries.newest_per_group(history(dom), "zone_id", [F.col("created_at").desc(), F.col("id").desc()], 20).select("id", "zone_id", "created_at")


@query("p46_weather_series", """SELECT zone_id, coalesce(observed_at, created_at) AS "time", temperature FROM (SELECT *, row_number() OVER
    (PARTITION BY zone_id ORDER BY created_at DESC, id DESC) AS rn FROM hist) WHERE rn <= 20 ORDER BY zone_id, created_at, id""", hist=HISTORY)
def p46(dom: Domain):
    return summaries.weather_series(history(dom)).select("zone_id", "time", "temperature")


@query("j18_latest_run", """SELECT source_id, id AS run_id, status AS last_status, error_summary AS last_error, started_at, status = 'processed' AS processed
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rn FROM runs) WHERE rn = 1""")
def j18(dom: Domain):
    return registry.current_status(dom.runs)


@query("j18_last_runs", "SELECT id, source_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rn FROM runs) WHERE rn <= 20")
def j18l(dom: Domain):
    return summaries.newest_per_group(dom.runs, "source_id", [F.col("started_at").desc(), F.col("id").desc()], 20).select("id", "source_id", "status")


@query("j19_first_alert_per_zone", """SELECT z.id, name, a.id AS alert_id, a.severity AS alert_severity FROM zones z LEFT JOIN (SELECT *, row_number() OVER
    (PARTITION BY zone_id ORDER BY created_at DESC, id DESC) AS rn FROM alerts WHERE is_active) a ON a.zone_id = z.id AND rn = 1""")
def j19(dom: Domain):
    return summaries.first_alert_per_zone(dom.zones, dom.alerts)


MATCH = """SELECT question_id, arg_max(zone_id, len * 1000000000 + zone_id) AS zone_id FROM (SELECT q.question_id, n.zone_id, length(n.txt) AS len FROM questions q,
    (SELECT lower(txt) AS txt, max(id) AS zone_id FROM (SELECT id, name AS txt FROM zones UNION ALL SELECT id, state FROM zones) GROUP BY 1) n
    WHERE contains(lower(q.question), n.txt)) GROUP BY 1"""


@query("j17_question_zone", "SELECT question_id, zone_id FROM m", m=MATCH)
def j17(dom: Domain):
    return assistant.match_zones(dom.questions, dom.zones)


STAMP = "strftime(updated_at, '%d %b %Y, %H:%M')"
SENTENCE = ("name || ' (' || state || '): ' || CASE WHEN risk_level = 'UNKNOWN' THEN 'no score' || CASE WHEN historical_event_count > 0 "
            "THEN '; past events: ' || historical_event_count ELSE '' END "
            f"ELSE risk_level || ', ' || printf('%.1f', risk_score) || ' of 100, as of ' || {STAMP} END")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("z06_answers", f"""SELECT question_id, intent, zone_id, CASE intent
    WHEN 'riskiest_place' THEN (SELECT {_q(assistant.RISKIEST_HEAD)} || list_extract(l, 1) || {_q(assistant.RISKIEST_NEXT)} || array_to_string(list_slice(l, 2, 3), chr(10)) FROM top3)
    WHEN 'alerts' THEN (SELECT 'Open alerts: ' || n || chr(10) || lines || CASE WHEN n > 10 THEN chr(10) || 'and ' || (n - 10) || ' further' ELSE '' END FROM act)
    WHEN 'weather_lookup' THEN CASE WHEN name IS NULL THEN {_q(assistant.NO_WEATHER)} ELSE name || ' (' || state || '): rain in 24 h ' || rainfall_24h ||
      ' mm, humidity ' || humidity || ' %, temperature ' || temperature || ' C, as of ' || {STAMP} END
    WHEN 'state_event_count' THEN CASE WHEN state IS NULL THEN {_q(assistant.NO_STATE)} ELSE 'Recorded events in ' || state || ': ' || n_events END
    WHEN 'place_lookup' THEN CASE WHEN name IS NULL THEN {_q(assistant.NO_ZONE)} ELSE sentence END ELSE {_q(assistant.HELP)} END AS answer FROM joined""",
       m=MATCH, lines3=f"SELECT {SENTENCE} AS sentence, row_number() OVER (ORDER BY risk_score DESC, id) AS rn FROM zones WHERE risk_level <> 'UNKNOWN'",
       top3="SELECT list(sentence ORDER BY rn) AS l FROM lines3 WHERE rn <= 3",
       act="""SELECT (SELECT count(*) FROM alerts WHERE is_active) AS n, string_agg(title || ' (' || severity || ')', chr(10) ORDER BY id) AS lines FROM
         (SELECT * FROM alerts WHERE is_active ORDER BY id LIMIT 10)""",
       routed="""SELECT *, CASE question_id % 9 WHEN 0 THEN 'riskiest_place' WHEN 1 THEN 'alerts' WHEN 2 THEN 'weather_lookup' WHEN 3 THEN 'state_event_count'
         WHEN 4 THEN 'place_lookup' WHEN 5 THEN 'unrecognized' WHEN 6 THEN 'help' WHEN 7 THEN 'place_lookup' ELSE 'place_lookup' END AS intent FROM questions""",
       joined=f"""SELECT r.question_id, r.intent, CASE WHEN r.intent IN ('weather_lookup', 'state_event_count', 'place_lookup') THEN m.zone_id END AS zone_id, z.* EXCLUDE (id),
         {SENTENCE} AS sentence, coalesce(e.n, 0) AS n_events
         FROM routed r LEFT JOIN m USING (question_id) LEFT JOIN zones z ON z.id = m.zone_id LEFT JOIN (SELECT state AS st, count(*) AS n FROM haz GROUP BY 1) e ON e.st = z.state""")
def z06(dom: Domain):
    return assistant.answer(dom.questions, dom.zones, dom.alerts, dom.events)
