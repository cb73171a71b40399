"""Dashboard aggregates, completeness reports, timeline, evaluation metrics, time split."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import evaluation, summaries
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.rasters import COVERED  # noqa: F401 - shared fragment

query = CATALOG.query


@query("a09_event_completeness", """SELECT source_id, count(*) AS stored_records, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS with_coordinates,
    count(event_date) AS with_event_date, count(state) AS with_state, count(district) AS with_district, count(event_type) AS with_event_type,
    count(severity) AS with_severity FROM haz GROUP BY 1""")
def a09(dom: Domain):
    return summaries.event_completeness(dom.events)


@query("a09_rainfall_completeness", """SELECT source_id, count(*) AS stored_records, count(latitude) AS with_coordinates, count(observed_date) AS with_observed_date,
    count(station_id) AS with_station_id, count(rainfall_mm) AS with_rainfall_value FROM rain GROUP BY 1""")
def a09r(dom: Domain):
    return summaries.rainfall_completeness(dom.rainfall)


@query("a12_events_by_state", "SELECT coalesce(state, 'Unknown') AS state, count(*) AS \"count\" FROM haz GROUP BY 1")
def a12(dom: Domain):
    return summaries.events_by_state(dom.events)


@query("a13_events_by_source", "SELECT coalesce(display_name, h.source_id) AS source, count(*) AS \"count\" FROM haz h LEFT JOIN source_names n ON n.source_id = h.source_id GROUP BY 1")
def a13(dom: Domain):
    return summaries.events_by_source(dom.events, dom.source_names)


@query("a14_events_by_year", "SELECT CAST(year(event_date) AS VARCHAR) AS \"year\", count(*) AS \"count\" FROM haz WHERE event_date IS NOT NULL GROUP BY 1")
def a14(dom: Domain):
    return summaries.events_by_year(dom.events)


@query("a15_observations_by_station", "SELECT coalesce(nullif(station_id, ''), 'Unknown station') AS station, count(*) AS \"count\" FROM rain GROUP BY 1")
def a15(dom: Domain):
    return summaries.observations_by_station(dom.rainfall)


@query("a21_level_distribution", """SELECT level, (SELECT count(*) FROM zones WHERE risk_level = level) AS "count" FROM (VALUES ('LOW'), ('MODERATE'), ('HIGH'), ('CRITICAL')) v(level)""")
def a21(dom: Domain):
    return summaries.level_distribution(dom.zones)


@query("a21_level_distribution_nonzero", "SELECT risk_level AS level, count(*) AS \"count\" FROM zones WHERE risk_level <> 'UNKNOWN' GROUP BY 1")
def a21n(dom: Domain):
    return summaries.level_distribution(dom.zones, keep_empty=False)


@query("a22_zone_origin", "SELECT count(*) FILTER (source_type = 'demo_seed') AS reference_zones, count(*) FILTER (source_type <> 'demo_seed') AS real_zones FROM zones")
def a22(dom: Domain):
    return summaries.zone_origin(dom.zones)


@query("a23_coverage_summary", """SELECT *, CASE WHEN regions_with_real_data = 0 AND historical_landslide_events = 0 THEN 'prototype' WHEN regions_with_real_data < 5
    AND historical_landslide_events < 50 THEN 'partial_real_data' WHEN regions_with_real_data < 50 THEN 'regional_real_data' ELSE 'expanded_real_data' END AS coverage_status
    FROM (SELECT (SELECT count(*) FROM regions) AS monitoring_regions, (SELECT count(*) FROM regions WHERE source_type = 'external_real') AS regions_with_real_data,
    (SELECT count(*) FROM zones) AS total_zones, (SELECT count(*) FROM haz) AS historical_landslide_events, (SELECT count(*) FROM sources) AS registered_data_sources)""")
def a23(dom: Domain):
    return summaries.coverage_summary(dom.regions, dom.zones, dom.events, dom.sources)


@query("a24_data_status", """SELECT (SELECT count(*) FROM sources) AS sources_registered, (SELECT count(*) FROM sources WHERE processed) AS sources_processed,
    (SELECT count(*) FROM haz) AS landslide_events, (SELECT count(*) FROM rain) AS rainfall_observations, (SELECT count(*) > 0 FROM dem) AS dem_available,
    (SELECT count(*) > 0 FROM lc) AS landcover_available, (SELECT count(*) > 0 FROM rings) AS boundaries_available""")
def a24(dom: Domain):
    return summaries.data_status(dom.sources, dom.events, dom.rainfall, dom.dem, dom.landcover, dom.polygons)


@query("a26_distinct_states", "SELECT DISTINCT state FROM zones ORDER BY 1")
def a26(dom: Domain):
    return summaries.distinct_states(dom.zones)


@query("a26_event_states", "SELECT DISTINCT state FROM haz WHERE state IS NOT NULL ORDER BY 1")
def a26e(dom: Domain):
    return summaries.distinct_states(dom.events)


@query("a28_active_alerts", """SELECT (SELECT count(*) FROM alerts WHERE is_active) AS active, string_agg(title || ' (' || severity || ')', chr(10) ORDER BY id) AS lines
    FROM (SELECT * FROM alerts WHERE is_active ORDER BY id LIMIT 10)""")
def a28(dom: Domain):
    return summaries.active_alerts(dom.alerts)


@query("a28_state_event_count", "SELECT state, count(*) AS events FROM haz WHERE state = 'NATION_7' GROUP BY 1")
def a28s(dom: Domain):
    return dom.events.where("state = 'NATION_7'").groupBy("state").agg(F.count("*").alias("events"))


@query("a29_positive_dates", "SELECT min(event_date) AS first_date, max(event_date) AS last_date FROM haz")
def a29(dom: Domain):
    return dom.events.agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@query("w05_timeline", """SELECT CAST(g.range AS BIGINT) AS step, coalesce(n, 0) AS events, CAST(sum(coalesce(n, 0)) OVER (ORDER BY g.range) AS BIGINT) AS running_total FROM range(60) g LEFT JOIN
    (SELECT least(59, CAST(floor(CAST(ms - lo AS DOUBLE) / (hi - lo) * 60) AS BIGINT)) AS step, count(*) AS n FROM (SELECT epoch_ms(event_date) AS ms,
    min(epoch_ms(event_date)) OVER () AS lo, max(epoch_ms(event_date)) OVER () AS hi FROM haz WHERE event_date IS NOT NULL) GROUP BY 1) b ON b.step = g.range""")
def w05(dom: Domain):
    return summaries.timeline(dom.events)


@query("w04_time_split", """SELECT id, rn <= CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS is_train FROM (SELECT id, row_number() OVER (ORDER BY coalesce(event_date, created_at), id) AS rn,
    count(*) OVER () AS n FROM haz)""")
def w04(dom: Domain):
    rows = dom.events.select("id", F.coalesce("event_date", "created_at").alias("as_of"))
    return evaluation.time_split(rows, "as_of", ["id"]).select("id", "is_train")


PRED = """SELECT CASE WHEN l_returnflag = 'R' OR s > 800 THEN 1 ELSE 0 END AS label, CAST(s AS DOUBLE) / 1000 AS score, CASE WHEN s >= 500 THEN 1 ELSE 0 END AS prediction
    FROM (SELECT *, (l_orderkey * 7919 + l_linenumber * 13) % 1000 AS s FROM lineitem)"""


def predictions(dom: Domain):
    s = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 13, F.lit(1000))
    return dom.table("lineitem").select(
        F.when((F.col("l_returnflag") == "R") | (s > 800), 1).otherwise(0).alias("label"), (s.cast("double") / F.lit(1000.0)).alias("score"),
        F.when(s >= 500, 1).otherwise(0).alias("prediction"))


@query("a30_confusion", "SELECT label, prediction, count(*) AS \"rows\" FROM pred GROUP BY 1, 2", pred=PRED)
def a30(dom: Domain):
    return evaluation.confusion(predictions(dom))


@query("a30_class_metrics", """SELECT c AS "class", round(h / p, 4) AS precision, round(h / s, 4) AS recall, round(2 * h / (p + s), 4) AS f1, s AS support FROM (SELECT c,
    count(*) FILTER (label = c AND prediction = c) AS h, count(*) FILTER (prediction = c) AS p, count(*) FILTER (label = c) AS s FROM pred, (VALUES (0), (1)) v(c) GROUP BY c)""", pred=PRED)
def a30m(dom: Domain):
    return evaluation.class_metrics(predictions(dom))


CURVE = """SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM (SELECT score,
    count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pred GROUP BY 1)"""


@query("a31_average_precision", "SELECT round(sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos), 4) AS pr_auc FROM curve", pred=PRED, curve=CURVE)
def a31(dom: Domain):
    return evaluation.average_precision(predictions(dom))


@query("a32_roc_area", "SELECT round(sum(neg * (CAST(tp AS DOUBLE) - CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 4) AS roc_auc FROM curve", pred=PRED, curve=CURVE)
def a32(dom: Domain):
    return evaluation.roc_area(predictions(dom))
