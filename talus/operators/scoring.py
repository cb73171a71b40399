"""Batch risk scoring, alert reconciliation, operator actions, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus import vocab
from talus.functions import risk
from talus.runtime import attach_to_groups

ENVIRONMENT = ["rainfall_24h", "rainfall_7d", "humidity", "temperature", "slope", "elevation", "vegetation",
               "historical_landslide"]


def _factors() -> dict[str, Column]:
    return {n: F.col(f"factor_{n}") for n in vocab.FACTORS}


def zone_detail(zones: DataFrame) -> DataFrame:
    """Every zone with its factor breakdown; factors are 0 where scoring would be guesswork."""
    guard = risk.needs_guard(F.col("source_type"), F.col("terrain_data_real"))
    factors = risk.factor_columns({c: F.col(c) for c in ENVIRONMENT})
    return zones.withColumns({f"factor_{n}": F.when(guard, 0.0).otherwise(v) for n, v in factors.items()})


def score_zones(zones: DataFrame, model_scores: DataFrame | None = None) -> DataFrame:
    """Recomputed score and level per zone: model first where one answered, else the rules.

    Guarded zones keep their stored score and level. `model_scores` has id, ml_score, ml_level.
    """
    out = zone_detail(zones)
    guard = risk.needs_guard(F.col("source_type"), F.col("terrain_data_real"))
    rule_score = risk.total_score(_factors())
    if model_scores is None:
        out = out.withColumn("ml_score", F.lit(None).cast("double")).withColumn("ml_level", F.lit(None).cast("string"))
    else:
        out = out.join(model_scores, "id", "left")
    score = F.coalesce("ml_score", rule_score)
    level = F.coalesce("ml_level", risk.level(rule_score))
    source = F.when(guard, vocab.GUARDED_SOURCE).when(F.col("ml_score").isNotNull(), vocab.MODEL_SOURCE).otherwise(vocab.RULE_SOURCE)
    return (
        out.withColumn("prediction_source", source)
        .withColumn("risk_score", F.when(guard, F.col("risk_score")).otherwise(score))
        .withColumn("risk_level", F.when(guard, F.col("risk_level")).otherwise(level))
        .withColumn("guarded", guard)
        .drop("ml_score", "ml_level")
    )


def availability(guarded: Column | None = None) -> Column:
    """field -> is present; a guarded zone reports only that it has no real environment."""
    pairs = []
    for name in ENVIRONMENT:
        pairs += [F.lit(name), F.col(name).isNotNull()]
    full = F.create_map(*pairs)
    if guarded is None:
        return full
    return F.when(guarded, F.create_map(F.lit("real_environmental_data"), F.lit(False))).otherwise(full)


def audit_rows(scored: DataFrame, triggered_by: str, at: Column) -> DataFrame:
    """Append-only log row per recomputation, with its inputs, their presence and the source used."""
    return scored.select(
        F.col("id").alias("zone_id"),
        F.lit(triggered_by).alias("triggered_by"),
        F.struct(*ENVIRONMENT).alias("inputs"),
        availability(F.col("guarded")).alias("data_availability"),
        "prediction_source", "risk_score", "risk_level",
        at.alias("created_at"),
    )


def factor_breakdown(zones: DataFrame) -> DataFrame:
    """Factors of every zone, largest first, each as a share of the largest, with a label."""
    detail = zone_detail(zones)
    top = F.greatest(*[F.col(f"factor_{n}") for n in vocab.FACTORS], F.lit(0.0001))
    rows = detail.select("id", top.alias("top"), F.posexplode(risk.factor_array(_factors())).alias("place", "f"))
    fraction = F.col("f.value") / F.col("top")
    return rows.select(
        "id", F.col("f.name").alias("factor"), F.col("f.value").alias("value"), fraction.alias("fraction"),
        risk.contribution_label(fraction).alias("label"), "place",
    )


def decide(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per zone what its open alerts need: keep, resolve, open, or nothing.

    Open alerts are counted per zone and severity before the join, so a zone with very many alerts
    costs one row here.
    """
    per_zone = alerts.where("is_active").groupBy("zone_id").agg(
        F.count("*").alias("open_alerts"),
        *[F.count_if(F.col("severity") == s).alias(f"open_{s}") for s in vocab.ALERT_LEVELS],
    )
    joined = scored.join(per_zone, scored["id"] == per_zone["zone_id"], "left").drop("zone_id")
    opened = F.coalesce("open_alerts", F.lit(0))
    same = None
    for name in vocab.ALERT_LEVELS:
        term = (F.col("risk_level") == name) & (F.coalesce(f"open_{name}", F.lit(0)) > 0)
        same = term if same is None else same | term
    alarming = F.col("risk_level").isin(*vocab.ALERT_LEVELS)
    action = (
        F.when(F.col("guarded"), "none")
        .when(~alarming & (opened > 0), "resolve")
        .when(~alarming, "none")
        .when(same, "keep")
        .otherwise("open")
    )
    return (
        joined.withColumn("action", action)
        .withColumn("alert_created", F.col("action") == "open")
        .withColumn("alert_updated", F.col("action").isin("resolve", "open") & (opened > 0))
        .drop("open_alerts", *[f"open_{s}" for s in vocab.ALERT_LEVELS])
    )


def new_alerts(decided: DataFrame, at: Column) -> DataFrame:
    reason = risk.top_factor_reason(_factors())
    return decided.where(F.col("action") == "open").select(
        F.col("id").alias("zone_id"),
        risk.alert_title(F.col("name")).alias("title"),
        risk.alert_message(F.col("name"), F.col("state"), F.col("risk_score"), F.col("risk_level"), reason).alias("message"),
        F.col("risk_level").alias("severity"),
        F.lit("active").alias("status"),
        F.lit(True).alias("is_active"),
        "risk_score",
        reason.alias("reason"),
        at.alias("created_at"),
    )


def reconcile(scored: DataFrame, alerts: DataFrame, at: Column) -> DataFrame:
    """The alert table after one pass: superseded alerts resolved, never deleted; new ones appended."""
    decided = decide(scored, alerts)
    verdict = decided.select(F.col("id").alias("zone_id"), "action")
    closes = F.col("is_active") & F.coalesce(F.col("action").isin("resolve", "open"), F.lit(False))
    base = alerts if "resolved_at" in alerts.columns else alerts.withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    kept = (
        attach_to_groups(base, verdict, ["zone_id"])
        .withColumn("status", F.when(closes, "resolved").otherwise(F.col("status")))
        .withColumn("resolved_at", F.when(closes, at).otherwise(F.col("resolved_at")))
        .withColumn("is_active", F.col("is_active") & ~closes)
        .drop("action")
    )
    return kept.unionByName(new_alerts(decided, at), allowMissingColumns=True)


def missing_alerts(zones: DataFrame, alerts: DataFrame) -> DataFrame:
    """An alert for every HIGH or CRITICAL zone that has no active one."""
    at_risk = zones.where(F.col("risk_level").isin(*vocab.ALERT_LEVELS))
    active = alerts.where("is_active").select(F.col("zone_id").alias("id"))
    return at_risk.join(active, "id", "left_anti").select(
        F.col("id").alias("zone_id"),
        risk.alert_title(F.col("name")).alias("title"),
        risk.alert_message(F.col("name"), F.col("state"), F.col("risk_score"), F.col("risk_level"),
                           F.lit(vocab.STATIC_ALERT_REASON)).alias("message"),
        F.col("risk_level").alias("severity"),
    )


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Fold operator actions (alert_id, action, at, seq) into the alerts.

    Acknowledging keeps an alert active and is refused once it is resolved; resolving is final.
    Everything is a min/max per alert, so a busy alert is combined before the shuffle.
    """
    order = F.struct("at", "seq")
    resolves = F.when(F.col("action") == "resolve", order)
    first = actions.groupBy("alert_id").agg(F.min(resolves).alias("first_resolve"), F.max(resolves).alias("last_resolve"))
    marked = attach_to_groups(actions, first.select("alert_id", "first_resolve"), ["alert_id"])
    initially = alerts.select(F.col("id").alias("alert_id"), (F.col("status") == "resolved").alias("closed"))
    marked = marked.join(initially, "alert_id")
    ack = F.col("action") == "acknowledge"
    accepted = ack & ~F.col("closed") & (F.col("first_resolve").isNull() | (order < F.col("first_resolve")))
    folded = marked.groupBy("alert_id").agg(
        F.max(F.when(accepted, F.col("at"))).alias("acknowledged_at"),
        F.count_if(ack & ~accepted).alias("refused"),
    ).join(first.select("alert_id", F.col("last_resolve.at").alias("resolved_at")), "alert_id")
    out = alerts.join(folded, alerts["id"] == folded["alert_id"], "left").drop("alert_id")
    done = F.col("resolved_at").isNotNull()
    return (
        out.withColumn("status", F.when(done, "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise(F.col("status")))
        .withColumn("is_active", F.col("is_active") & ~done)
        .withColumn("refused", F.coalesce("refused", F.lit(0).cast("long")))
    )


def overlay_weather(zones: DataFrame, readings: DataFrame) -> DataFrame:
    """Only the fields a provider actually returned replace the zone's own values."""
    fields = ["temperature", "humidity", "rainfall_24h"]
    new = readings.select(
        F.col("zone_id").alias("id"), F.col("available").alias("_available"), *[F.col(f).alias(f"_{f}") for f in fields]
    )
    joined = zones.join(new, "id", "left")
    usable = F.coalesce("_available", F.lit(False))
    return (
        joined.withColumns({f: F.when(usable, F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in fields})
        .withColumn("weather_available", F.col("_available"))
        .drop("_available", *[f"_{f}" for f in fields])
    )
