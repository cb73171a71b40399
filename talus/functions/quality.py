"""Validation codes and completeness scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus import vocab
from talus.functions.text import to_double


def _codes(*terms: Column) -> Column:
    return F.array_compact(F.array(*terms))


def coordinate_errors(lat: Column, lon: Column) -> Column:
    """Reasons a coordinate is unusable; NaN counts as out of range."""
    present = lat.isNotNull() & lon.isNotNull()
    return _codes(
        F.when(~present, "missing_coordinates"),
        F.when(present & ~lat.between(*vocab.LATITUDE_RANGE), "invalid_latitude"),
        F.when(present & ~lon.between(*vocab.LONGITUDE_RANGE), "invalid_longitude"),
    )


def value_errors(columns: dict[str, Column]) -> Column:
    """Range checks in the order of vocab.VALUE_RANGES; a NULL value passes."""
    terms = []
    for field, (low, high) in vocab.VALUE_RANGES.items():
        if field not in columns:
            continue
        value = columns[field]
        # A lower bound alone rejects only values below it; a two-sided range also rejects NaN.
        bad = value < low if high is None else ~value.between(low, high)
        terms.append(F.when(value.isNotNull() & bad, f"invalid_{field}"))
    return _codes(*terms)


def date_errors(raw: Column) -> Column:
    return _codes(F.when(raw.isNull() | (F.trim(raw.cast("string")) == ""), "missing_date"))


def vegetation_fraction(raw: Column, scale: str = "0-1") -> Column:
    """Vegetation reading on 0..1 from a fraction, a percentage or raw NDVI."""
    value = to_double(raw)
    if scale == "0-100":
        value = value / F.lit(100.0)
    elif scale == "ndvi":
        value = (value + F.lit(1.0)) / F.lit(2.0)
    clamped = F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return F.round(clamped, 4)


def historical_flag(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind == "landslide_inventory", True)
        .when(raw.isNull() | (raw == ""), None)
        .otherwise(F.lower(F.trim(raw)).isin("true", "1", "yes"))
    )


def _present(columns: dict[str, Column], field: str) -> Column:
    if field == "event_date":
        return columns[field].isNotNull() & (columns[field].cast("string") != "")
    return columns[field].isNotNull()


def record_completeness(columns: dict[str, Column]) -> tuple[Column, Column]:
    """Score 0-100 and the list of missing fields. Completeness only, never a risk value."""
    score = F.lit(0)
    missing = []
    for group, fields in vocab.RECORD_FIELD_GROUPS.items():
        flags = [_present(columns, f) for f in fields]
        earned = flags[0]
        for other in flags[1:]:
            earned = (earned & other) if group == "coordinates" else (earned | other)
        score = score + F.when(earned, vocab.RECORD_WEIGHTS[group]).otherwise(0)
        missing += [F.when(~seen, f) for f, seen in zip(fields, flags)]
    return score, _codes(*missing)


def event_completeness(date: Column, kind: Column, severity: Column, place: Column) -> Column:
    weights = vocab.EVENT_WEIGHTS
    score = F.lit(weights["base"])
    for name, value in [("date", date), ("type", kind), ("severity", severity), ("place", place)]:
        score = score + F.when(value.isNotNull(), weights[name]).otherwise(0)
    return score
