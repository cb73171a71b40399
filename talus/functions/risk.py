"""Deterministic risk score, levels, factor reasons, alert wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus import vocab


def _share(value: Column, name: str) -> Column:
    top, _ = vocab.RISK_SCALE[name]
    return F.when(
        value.isNotNull(), F.greatest(F.lit(0.0), F.least(value, F.lit(top))) / F.lit(top)
    )


def _points(name: str) -> Column:
    return F.lit(vocab.RISK_SCALE[name][1])


def factor_columns(zone: dict[str, Column]) -> dict[str, Column]:
    """The five weighted factors, each clamped to its range and rounded to 2 decimals."""
    rain = _share(zone["rainfall_24h"], "rainfall_24h") * _points("rainfall_24h") + _share(
        zone["rainfall_7d"], "rainfall_7d"
    ) * _points("rainfall_7d")
    bare = F.lit(1.0) - _share(zone["vegetation"], "vegetation")
    return {
        "rainfall": F.round(rain, 2),
        "slope": F.round(_share(zone["slope"], "slope") * _points("slope"), 2),
        "vegetation": F.round(bare * _points("vegetation"), 2),
        "historical": F.when(zone["historical_landslide"], _points("historical")).otherwise(0.0),
        "humidity": F.round(_share(zone["humidity"], "humidity") * _points("humidity"), 2),
    }


def total_score(factors: dict[str, Column]) -> Column:
    total = factors[vocab.FACTORS[0]]
    for name in vocab.FACTORS[1:]:
        total = total + factors[name]
    return F.round(F.when(total.isNotNull(), F.least(total, F.lit(100.0))), 2)


def level(score: Column) -> Column:
    label = F.when(score.isNull(), None)
    for name, upper in vocab.LEVEL_LIMITS:
        label = label.when(score <= upper, name)
    return label.otherwise("CRITICAL")


def severity_rank(name: Column) -> Column:
    rank = None
    for label, value in vocab.SEVERITY_RANK.items():
        rank = F.when(name == label, value) if rank is None else rank.when(name == label, value)
    return rank.otherwise(99)


def score_from_probabilities(probabilities: Column, labels: list[str]) -> Column:
    """Class probabilities (array in `labels` order) to a 0-100 score."""
    weights = F.array(*[F.lit(vocab.LEVEL_SCORES[name]) for name in labels])
    weighted = F.zip_with(probabilities, weights, lambda p, w: F.round(p, 4) * w)
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)


def factor_array(factors: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), factors[n].alias("value")) for n in vocab.FACTORS])


def top_factor(factors: dict[str, Column]) -> Column:
    """Label of the first largest factor, in the fixed factor order."""
    top = F.greatest(*[factors[n] for n in vocab.FACTORS])
    leader = F.filter(factor_array(factors), lambda x: x["value"] == top)
    return F.initcap(F.replace(F.get(leader, F.lit(0))["name"], F.lit("_"), F.lit(" ")))


def top_factor_reason(factors: dict[str, Column]) -> Column:
    return F.concat(F.lit("Primary contributing factor: "), top_factor(factors), F.lit("."))


def alert_title(name: Column) -> Column:
    return F.concat(F.lit("LANDSLIDE WARNING - "), name)


def alert_message(name: Column, state: Column, score: Column, level_name: Column, reason: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Location: "), name, F.lit(", "), state),
        F.concat(F.lit("Risk Score: "), score.cast("string"), F.lit("/100")),
        F.concat(F.lit("Risk Level: "), level_name),
        reason,
    )


def needs_guard(source_type: Column, terrain_real: Column) -> Column:
    """A derived zone without measured terrain must not be scored from placeholder inputs."""
    return (source_type == "derived") & ~F.coalesce(terrain_real, F.lit(False))


def coverage_status(regions: Column, events: Column) -> Column:
    return (
        F.when((regions == 0) & (events == 0), "prototype")
        .when((regions < 5) & (events < 50), "partial_real_data")
        .when(regions < 50, "regional_real_data")
        .otherwise("expanded_real_data")
    )


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.lit(100.0) * part / F.nullif(total, F.lit(0)), 0)).otherwise(0.0).cast("int")


def contribution_label(fraction: Column) -> Column:
    return F.when(fraction >= 0.66, "High contribution").when(fraction >= 0.33, "Moderate contribution").otherwise(
        "Low contribution"
    )
