"""Row classification for ingestion: normalize, validate, first-wins duplicates, known keys, counts.

Input rows are all text with one `_order` column that sorts as the file does. Which row of a group of
copies is first is a `min` per key, combined before the shuffle; rows are never gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import quality, text
from talus.runtime import attach_to_groups
from talus.sources.files import column_map
from talus.sources.known_keys import KnownKeys


def pick(df: DataFrame, mapping: dict[str, str | None], field: str) -> Column:
    """The mapped column with blanks as NULL; NULL when the file has no such column."""
    column = mapping.get(field)
    if column is None:
        return F.lit(None).cast("string")
    return text.blank_to_null(df[column].cast("string"))


def number(df: DataFrame, mapping: dict[str, str | None], field: str) -> Column:
    """The mapped column as a number; blank text is no number anyway."""
    column = mapping.get(field)
    return F.lit(None).cast("double") if column is None else text.to_double(df[column].cast("string"))


# ---- record normalization (validation pass over an inventory) -----------------------------------

RECORD_NUMBERS = ["rainfall_24h", "rainfall_7d", "humidity", "temperature", "elevation", "slope"]


def normalize_records(df: DataFrame, source_name: str, index: Column | None = None) -> DataFrame:
    """Raw rows to the common record. Absent fields stay NULL; risk_level is always NULL."""
    mapping = column_map(df.columns)
    get = lambda f: pick(df, mapping, f)
    fallback = F.concat(F.lit(f"{source_name}-"), (index if index is not None else F.col("index")).cast("string"))
    return df.select(
        "_order",
        text.once(
            location_id=F.coalesce(get("location_id"), fallback),
            latitude=number(df, mapping, "latitude"),
            longitude=number(df, mapping, "longitude"),
            event_date=get("date"),
            **{f: number(df, mapping, f) for f in RECORD_NUMBERS},
            vegetation=quality.vegetation_fraction(get("vegetation")),
        ),
    ).select(
        "*",
        F.lit(True).alias("historical_landslide"),
        F.lit(None).cast("string").alias("risk_level"),
        F.lit("landslide_inventory").alias("dataset_kind"),
        F.lit("external").alias("source_type"),
        F.lit(source_name).alias("source_name"),
    )


def validate_records(records: DataFrame, require_date: bool = False) -> DataFrame:
    """Adds `errors`. An invalid first row still claims its (lat, lon, date) key; a row whose key is
    entirely NULL is never a duplicate."""
    key = ["latitude", "longitude", "event_date"]
    firsts = records.groupBy(*key).agg(F.min("_order").alias("_first"), F.count("*").alias("_copies"))
    repeated = firsts.where(
        (F.col("_copies") > 1)
        & (F.col("latitude").isNotNull() | F.col("longitude").isNotNull() | F.col("event_date").isNotNull())
    ).drop("_copies")
    marked = attach_to_groups(records, repeated, key)
    checks = [
        quality.coordinate_errors(F.col("latitude"), F.col("longitude")),
        quality.value_errors({f: F.col(f) for f in ["rainfall_24h", "rainfall_7d", "humidity", "vegetation", "slope", "elevation"]}),
    ]
    if require_date:
        checks.append(quality.date_errors(F.col("event_date")))
    later = F.array_compact(F.array(F.when(F.col("_order") > F.col("_first"), "duplicate_record")))
    return marked.withColumn("errors", F.concat(*checks, later)).drop("_first")


def with_completeness(records: DataFrame) -> DataFrame:
    fields = ["latitude", "longitude", "rainfall_24h", "rainfall_7d", "humidity", "temperature", "slope", "elevation",
              "vegetation", "historical_landslide", "event_date"]
    score, missing = quality.record_completeness({f: F.col(f) for f in fields})
    return records.withColumn("data_quality_score", score).withColumn("missing_features", missing)


def validation_summary(validated: DataFrame) -> DataFrame:
    bad = F.size("errors") > 0
    return validated.agg(
        F.count("*").alias("total_records"),
        F.count_if(~bad).alias("valid_records"),
        F.count_if(bad).alias("invalid_records"),
        F.count_if(F.array_contains("errors", "missing_coordinates")).alias("missing_coordinates"),
        F.count_if(F.array_contains("errors", "duplicate_record")).alias("duplicates"),
    )


# ---- ingestion into a stored table --------------------------------------------------------------

def _place(df: DataFrame, mapping: dict[str, str | None]) -> dict[str, Column]:
    """Both coordinates as text and as numbers."""
    return {
        "_lat_text": pick(df, mapping, "latitude"), "_lon_text": pick(df, mapping, "longitude"),
        "_lat": number(df, mapping, "latitude"), "_lon": number(df, mapping, "longitude"),
    }


def _paired(name: str) -> Column:
    # One unreadable coordinate makes both unusable.
    readable = (F.col("_lat").isNotNull() | F.col("_lat_text").isNull()) & (F.col("_lon").isNotNull() | F.col("_lon_text").isNull())
    return F.when(readable, F.col(name))


def read_events(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    get = lambda f: pick(df, mapping, f)
    return df.select(
        "_order",
        text.once(
            source_record_id=F.coalesce(get("source_record_id"), get("location_id")),
            **_place(df, mapping),
            event_date=text.parse_date(get("date")),
            event_type=get("event_type"),
            severity=get("severity"),
            state=get("state"),
        ),
        _raw(df),
    ).select(
        "_order", "source_record_id", _paired("_lat").alias("latitude"), _paired("_lon").alias("longitude"),
        "event_date", "event_type", "severity", "state", "raw",
    )


def read_rainfall(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    get = lambda f: pick(df, mapping, f)
    return df.select(
        "_order",
        text.once(
            source_record_id=get("source_record_id"),
            station_id=get("station_id"),
            **_place(df, mapping),
            observed_date=text.parse_date(get("date")),
            rainfall_mm=number(df, mapping, "rainfall"),
        ),
        _raw(df),
    ).select(
        "_order", "source_record_id", "station_id", _paired("_lat").alias("latitude"), _paired("_lon").alias("longitude"),
        "observed_date", "rainfall_mm", "raw",
    )


def _raw(df: DataFrame) -> Column:
    pairs = []
    for c in df.columns:
        if not c.startswith("_"):
            pairs += [F.lit(c), df[c].cast("string")]
    return (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("raw")


def reject_reasons(rows: DataFrame, rainfall: bool = False) -> DataFrame:
    reasons = quality.coordinate_errors(F.col("latitude"), F.col("longitude"))
    if rainfall:
        dry = F.when((F.size(reasons) == 0) & (F.col("rainfall_mm") < 0), "invalid_rainfall")
        reasons = F.concat(reasons, F.array_compact(F.array(dry)))
    return rows.withColumn("reasons", reasons)


def _key(date: str) -> list[Column]:
    """Record-id rows and id-less rows live in separate key spaces."""
    by_id = F.col("source_record_id").isNotNull() & (F.col("source_record_id") != "")
    free = ~F.coalesce(by_id, F.lit(False))
    return [
        F.when(~free, F.col("source_record_id")).alias("k_id"),
        F.when(free, F.round("latitude", 6)).alias("k_lat"),
        F.when(free, F.round("longitude", 6)).alias("k_lon"),
        F.when(free, F.col(date)).alias("k_date"),
    ]


KEYS = ["k_id", "k_lat", "k_lon", "k_date"]


def first_rows(usable: DataFrame, date: str) -> DataFrame:
    """First row of every key in file order; one combinable aggregation, no window, no self-join."""
    keyed = usable.select(*usable.columns, *_key(date))
    rest = [c for c in usable.columns if c not in ("_order", "raw", "reasons")]
    return keyed.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), "_order").alias("_row"), F.min("_order").alias("_order")).select(
        *KEYS, "_order", *[F.col("_row")[c].alias(c) for c in rest]
    )


def not_stored(firsts: DataFrame, stored: DataFrame | KnownKeys | None, date: str) -> DataFrame:
    """Drop keys the table already holds for this source; a NULL date equals a NULL date.

    Every stored row blocks its composite key, also when it has a record id. `stored` holds the rows themselves or
    is a store of their keys.
    """
    if stored is None:
        return firsts
    if isinstance(stored, KnownKeys):
        return stored.unknown(firsts)
    nothing = lambda name: F.lit(None).cast(dict(firsts.dtypes)[name]).alias(name)
    ids = stored.where(F.col("source_record_id") != "").select(
        F.col("source_record_id").alias("k_id"), *[nothing(k) for k in KEYS[1:]]
    )
    places = stored.select(
        nothing("k_id"), F.round("latitude", 6).alias("k_lat"), F.round("longitude", 6).alias("k_lon"), F.col(date).alias("k_date")
    )
    # One null-safe anti join on the whole key: rows of either key space stay spread over all tasks,
    # which two joins would not keep (all rows without an id would share the NULL id).
    known = ids.unionByName(places).toDF(*[f"_{k}" for k in KEYS])
    same = firsts["k_id"].eqNullSafe(known["_k_id"])
    for k in KEYS[1:]:
        same = same & firsts[k].eqNullSafe(known[f"_{k}"])
    return firsts.join(known, same, "left_anti")


def accept(rows: DataFrame, stored: DataFrame | KnownKeys | None, date: str) -> DataFrame:
    """Rows to store: usable, first of their key in the file, not stored yet."""
    usable = rows.where(F.size("reasons") == 0)
    return not_stored(first_rows(usable, date), stored, date)


def flag_duplicates(rows: DataFrame, date: str) -> DataFrame:
    """Every row with `is_duplicate`; rejected rows claim no key and are no duplicates."""
    keyed = rows.select(*rows.columns, *_key(date))
    firsts = (
        keyed.where(F.size("reasons") == 0).groupBy(*KEYS)
        .agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    )
    out = attach_to_groups(keyed, firsts, KEYS)
    later = (F.size("reasons") == 0) & F.coalesce(F.col("_order") > F.col("_first"), F.lit(False))
    return out.withColumn("is_duplicate", later).drop("_first", *KEYS)


def ingestion_summary(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """total, valid, invalid, inserted, duplicates; valid rows are exactly the ones stored."""
    stored = accepted.agg(F.count("*").alias("n"))
    return rows.agg(
        F.count("*").alias("total_records"), F.count_if(F.size("reasons") > 0).alias("invalid_records")
    ).select(
        "total_records",
        stored.scalar().alias("valid_records"),
        "invalid_records",
        stored.scalar().alias("inserted"),
        (F.col("total_records") - F.col("invalid_records") - stored.scalar()).alias("duplicates"),
    )


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") > 0).select("_order", "reasons", "raw")


def reason_counts(rows: DataFrame, column: str = "reasons") -> DataFrame:
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def missing_per_column(df: DataFrame) -> DataFrame:
    """Blank cells per column in one pass over the table."""
    names = [c for c in df.columns if not c.startswith("_")]
    blank = lambda c: F.count_if(text.blank_to_null(F.col(c).cast("string")).isNull()).alias(c)
    counts = df.agg(*[blank(c) for c in names])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in names])).alias("x")
    ).select("x.column", "x.missing")


def bounding_box(df: DataFrame) -> DataFrame:
    """Extent of the rows whose two coordinates both parse; no such row, all NULL."""
    mapping = column_map(df.columns)
    lat, lon = number(df, mapping, "latitude"), number(df, mapping, "longitude")
    return df.select(lat.alias("lat"), lon.alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL").agg(
        F.min("lat").alias("min_latitude"), F.max("lat").alias("max_latitude"),
        F.min("lon").alias("min_longitude"), F.max("lon").alias("max_longitude"),
    )
