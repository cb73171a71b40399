"""Risk score, levels, reasons, alerts and their state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus import vocab
from talus.functions import risk
from talus.operators import scoring
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.fragments import TOP_FACTOR, detail_view, level, scored_view

query = CATALOG.query
NOW = "2024-06-01 00:00:00"
VIEWS = {"detail": detail_view(), "scored": scored_view()}
F_SQL = ", ".join(f"f_{n} AS factor_{n}" for n in vocab.FACTORS)
GUARDED_SQL = ", ".join(f"CASE WHEN guarded THEN CAST(0 AS DOUBLE) ELSE f_{n} END AS factor_{n}" for n in vocab.FACTORS)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("p12_risk_score", f"""SELECT id, {F_SQL}, round(least(f_rainfall + f_slope + f_vegetation + f_historical + f_humidity, 100), 2) AS risk_score
    FROM detail""", **VIEWS)
def p12(dom: Domain):
    factors = risk.factor_columns({c: F.col(c) for c in scoring.ENVIRONMENT})
    return dom.zones.select("id", *[v.alias(f"factor_{k}") for k, v in factors.items()], risk.total_score(factors).alias("risk_score"))


@query("p13_risk_level", f"SELECT id, {level('risk_score')} AS risk_level FROM alerts")
def p13(dom: Domain):
    return dom.alerts.select("id", risk.level(F.col("risk_score")).alias("risk_level"))


# The weights make exact ties at the second decimal, so the check rounds the printed decimal half up.
@query("p14_score_from_probabilities", """SELECT id, CAST(round(CAST(CAST(a * 12.5 + b * 37.5 + c * 62.5 + e * 87.5 AS VARCHAR) AS DECIMAL(24, 18)), 2) AS DOUBLE) AS risk_score
    FROM (SELECT id, round(a / t, 4) AS a, round(b / t, 4) AS b, round(c / t, 4) AS c, round(e / t, 4) AS e FROM (SELECT id, a, b, c, e, a + b + c + e AS t
    FROM (SELECT id, rainfall_24h + 1 AS a, humidity + 1 AS b, slope + 1 AS c, temperature + 1 AS e FROM zones)))""")
def p14(dom: Domain):
    parts = [F.col(c) + 1 for c in ("rainfall_24h", "humidity", "slope", "temperature")]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return dom.zones.select("id", risk.score_from_probabilities(F.array(*[p / total for p in parts]), vocab.RISK_LEVELS).alias("risk_score"))


@query("p15_top_factor", f"SELECT id, {TOP_FACTOR} AS top_factor, 'Primary contributing factor: ' || {TOP_FACTOR} || '.' AS reason FROM detail", **VIEWS)
def p15(dom: Domain):
    factors = risk.factor_columns({c: F.col(c) for c in scoring.ENVIRONMENT})
    return dom.zones.select("id", risk.top_factor(factors).alias("top_factor"), risk.top_factor_reason(factors).alias("reason"))


MESSAGE = ("'Location: ' || name || ', ' || state || chr(10) || 'Risk Score: ' || risk_score || '/100' || chr(10) || 'Risk Level: ' || risk_level "
           "|| chr(10) || {reason}")
REASON = f"('Primary contributing factor: ' || {TOP_FACTOR} || '.')"


@query("p16_alert_text", f"SELECT id, 'LANDSLIDE WARNING - ' || name AS title, {MESSAGE.format(reason=REASON)} AS message FROM scored", **VIEWS)
def p16(dom: Domain):
    scored = scoring.score_zones(dom.zones)
    factors = risk.factor_columns({c: F.col(c) for c in scoring.ENVIRONMENT})
    return scored.select("id", risk.alert_title(F.col("name")).alias("title"), risk.alert_message(
        F.col("name"), F.col("state"), F.col("risk_score"), F.col("risk_level"), risk.top_factor_reason(factors)).alias("message"))


@query("p17_availability", "SELECT payload_id, temperature IS NOT NULL AS has_temperature, humidity IS NOT NULL AS has_humidity, rainfall_24h IS NOT NULL AS has_rain FROM readings")
def p17(dom: Domain):
    from talus.sources import weather

    # Weather readings with the other inputs absent; presence is read back out of the map.
    read = weather.readings(dom.payloads.withColumn("available", F.lit(True)))
    absent = [c for c in scoring.ENVIRONMENT if c not in read.columns]
    full = read.withColumns({c: F.lit(None).cast("double") for c in absent}).withColumn("seen", scoring.availability())
    return full.select("payload_id", F.col("seen")["temperature"].alias("has_temperature"), F.col("seen")["humidity"].alias("has_humidity"),
                       F.col("seen")["rainfall_24h"].alias("has_rain"))


@query("p27_guarded_score", f"""SELECT id, risk_score, risk_level, {GUARDED_SQL}, CASE WHEN guarded THEN '{vocab.GUARDED_SOURCE}'
    ELSE 'rule_based_fallback' END AS prediction_source FROM scored""", **VIEWS)
def p27(dom: Domain):
    out = scoring.score_zones(dom.zones)
    return out.select("id", "risk_score", "risk_level", *[f"factor_{n}" for n in vocab.FACTORS], "prediction_source")


@query("p28_coverage_status", """SELECT n_nationkey, CASE WHEN r = 0 AND e = 0 THEN 'prototype' WHEN r < 5 AND e < 50 THEN 'partial_real_data'
    WHEN r < 50 THEN 'regional_real_data' ELSE 'expanded_real_data' END AS coverage_status FROM (SELECT n_nationkey,
    (SELECT count(*) FROM regions WHERE state = n_name AND source_type = 'external_real') AS r, (SELECT count(*) FROM haz WHERE state = n_name) AS e FROM nation)""")
def p28(dom: Domain):
    real = dom.regions.where("source_type = 'external_real'").groupBy(F.col("state").alias("n_name")).agg(F.count("*").alias("r"))
    events = dom.events.groupBy(F.col("state").alias("n_name")).agg(F.count("*").alias("e"))
    out = dom.table("nation").join(real, "n_name", "left").join(events, "n_name", "left")
    status = risk.coverage_status(F.coalesce("r", F.lit(0)), F.coalesce("e", F.lit(0)))
    return out.select("n_nationkey", status.alias("coverage_status"))


@query("p35_percent", """SELECT source_id, CAST(CASE WHEN total_records > 0 THEN round(CAST(100 * inserted AS DOUBLE) / total_records) ELSE 0 END AS INTEGER) AS percent,
    id FROM runs""")
def p35(dom: Domain):
    return dom.runs.select("id", "source_id", risk.percent(F.col("inserted"), F.col("total_records")).alias("percent"))


@query("p37_severity_rank", """SELECT id, CAST(CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END AS INTEGER) AS rank FROM zones""")
def p37(dom: Domain):
    return dom.zones.select("id", risk.severity_rank(F.col("risk_level")).alias("rank"))


LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY received_at DESC, payload_id DESC) AS rn FROM readings) WHERE rn = 1"""


@query("p38_weather_overlay", """SELECT z.id, CASE WHEN l.available THEN coalesce(l.temperature, z.temperature) ELSE z.temperature END AS temperature,
    CASE WHEN l.available THEN coalesce(l.humidity, z.humidity) ELSE z.humidity END AS humidity,
    CASE WHEN l.available THEN coalesce(l.rainfall_24h, z.rainfall_24h) ELSE z.rainfall_24h END AS rainfall_24h
    FROM zones z LEFT JOIN latest l ON l.zone_id = z.id""", latest=LATEST)
def p38(dom: Domain):
    from talus.sources import weather

    latest = weather.latest_per_zone(weather.readings(dom.payloads))
    return scoring.overlay_weather(dom.zones, latest).select("id", "temperature", "humidity", "rainfall_24h")


@query("p45_factor_breakdown", """SELECT id, factor, value, fraction, CASE WHEN fraction >= 0.66 THEN 'High contribution' WHEN fraction >= 0.33
    THEN 'Moderate contribution' ELSE 'Low contribution' END AS label, CAST(place AS INTEGER) AS place FROM (SELECT id, u.factor, u.value, u.place,
    u.value / greatest(g0, g1, g2, g3, g4, CAST(0.0001 AS DOUBLE)) AS fraction FROM g, LATERAL (VALUES ('rainfall', g0, 0), ('slope', g1, 1),
    ('vegetation', g2, 2), ('historical', g3, 3), ('humidity', g4, 4)) u(factor, value, place))""", **VIEWS,
       g="SELECT id, " + ", ".join(f"CASE WHEN guarded THEN CAST(0 AS DOUBLE) ELSE f_{n} END AS g{i}" for i, n in enumerate(vocab.FACTORS)) + " FROM detail")
def p45(dom: Domain):
    return scoring.factor_breakdown(dom.zones)


@query("j14_missing_alerts", f"""SELECT id AS zone_id, 'LANDSLIDE WARNING - ' || name AS title, {MESSAGE.format(reason="'" + vocab.STATIC_ALERT_REASON + "'")} AS message,
    risk_level AS severity FROM zones z WHERE risk_level IN ('HIGH', 'CRITICAL') AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.zone_id = z.id
    AND a.is_active AND a.created_at >= TIMESTAMP '2001-01-01')""")
def j14(dom: Domain):
    # Alerts before 2001 count as closed here, so that both outcomes occur.
    alerts = dom.alerts.withColumn("is_active", F.col("is_active") & (F.col("created_at") >= F.lit("2001-01-01").cast("timestamp_ntz")))
    return scoring.missing_alerts(dom.zones, alerts)


RECON = {
    **VIEWS,
    "open_alerts": "SELECT zone_id, count(*) AS n, bool_or(severity = 'HIGH') AS h, bool_or(severity = 'CRITICAL') AS c FROM calm WHERE is_active GROUP BY 1",
    "decided": """SELECT s.*, coalesce(n, 0) AS n, CASE WHEN guarded THEN 'none' WHEN risk_level NOT IN ('HIGH', 'CRITICAL')
        THEN CASE WHEN n > 0 THEN 'resolve' ELSE 'none' END WHEN risk_level = 'HIGH' AND h THEN 'keep' WHEN risk_level = 'CRITICAL' AND c THEN 'keep'
        ELSE 'open' END AS action FROM scored s LEFT JOIN open_alerts o ON o.zone_id = s.id""",
}
CALM = "SELECT * REPLACE (is_active AND created_at >= TIMESTAMP '2001-01-01' AS is_active) FROM alerts"


def calm(dom: Domain):
    """The alert table with everything before 2001 closed, so that every decision occurs."""
    return dom.alerts.withColumn("is_active", F.col("is_active") & (F.col("created_at") >= F.lit("2001-01-01").cast("timestamp_ntz")))


@query("t02_alert_decisions", """SELECT id, action, action = 'open' AS alert_created, action IN ('open', 'resolve') AND n > 0 AS alert_updated FROM decided""",
       calm=CALM, **RECON)
def t02(dom: Domain):
    return scoring.decide(scoring.score_zones(dom.zones), calm(dom)).select("id", "action", "alert_created", "alert_updated")


@query("t02_alert_table", f"""SELECT a.zone_id, a.title, a.severity, CASE WHEN shut THEN 'resolved' ELSE a.status END AS status, a.is_active AND NOT shut AS is_active,
    CASE WHEN shut THEN TIMESTAMP '{NOW}' END AS resolved_at, a.created_at FROM (SELECT c.*, coalesce(c.is_active AND d.action IN ('open', 'resolve'), false) AS shut
    FROM calm c LEFT JOIN decided d ON d.id = c.zone_id) a UNION ALL SELECT id, 'LANDSLIDE WARNING - ' || name, risk_level, 'active', true, NULL, TIMESTAMP '{NOW}'
    FROM decided WHERE action = 'open'""", calm=CALM, **RECON)
def t02_table(dom: Domain):
    return scoring.reconcile(scoring.score_zones(dom.zones), calm(dom), now()).select(
        "zone_id", "title", "severity", "status", "is_active", "resolved_at", "created_at")


ACTIONS = """SELECT l_orderkey AS alert_id, CASE WHEN l_returnflag = 'R' THEN 'resolve' ELSE 'acknowledge' END AS action, l_shipdate AS "at", l_partkey AS seq FROM lineitem"""


@query("t03_operator_actions", """SELECT a.id, CASE WHEN r_at IS NOT NULL THEN 'resolved' WHEN k_at IS NOT NULL THEN 'acknowledged' ELSE a.status END AS status,
    a.is_active AND r_at IS NULL AS is_active, k_at AS acknowledged_at, r_at AS resolved_at, coalesce(bad, 0) AS refused FROM alerts a LEFT JOIN
    (SELECT alert_id, max(CASE WHEN good THEN "at" END) AS k_at, count(CASE WHEN action = 'acknowledge' AND NOT good THEN 1 END) AS bad,
            max(CASE WHEN action = 'resolve' THEN "at" END) AS r_at FROM judged GROUP BY 1) f ON f.alert_id = a.id""", acts=ACTIONS,
       judged="""SELECT t.*, t.action = 'acknowledge' AND a.status <> 'resolved' AND NOT EXISTS (SELECT 1 FROM acts e WHERE e.alert_id = t.alert_id
        AND e.action = 'resolve' AND (e."at" < t."at" OR (e."at" = t."at" AND e.seq <= t.seq))) AS good FROM acts t JOIN alerts a ON a.id = t.alert_id""")
def t03(dom: Domain):
    actions = dom.table("lineitem").select(
        F.col("l_orderkey").alias("alert_id"), F.when(F.col("l_returnflag") == "R", "resolve").otherwise("acknowledge").alias("action"),
        F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("seq"))
    return scoring.apply_actions(dom.alerts, actions).select("id", "status", "is_active", "acknowledged_at", "resolved_at", "refused")


@query("z07_score_zones", """SELECT id, risk_score, risk_level, prediction_source, reason FROM (SELECT id, risk_score, risk_level, CASE WHEN guarded THEN """
       f"""'{vocab.GUARDED_SOURCE}' ELSE 'rule_based_fallback' END AS prediction_source, CASE WHEN guarded THEN 'Primary contributing factor: Rainfall.' ELSE {REASON} END AS reason FROM scored)""", **VIEWS)
def z07(dom: Domain):
    out = scoring.score_zones(dom.zones)
    factors = {n: F.col(f"factor_{n}") for n in vocab.FACTORS}
    return out.select("id", "risk_score", "risk_level", "prediction_source", risk.top_factor_reason(factors).alias("reason"))
