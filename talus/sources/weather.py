"""Landed weather payloads: schema, batch and streaming readers, one reading per payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.text import once, parse_iso

PAYLOAD_SCHEMA = (
    "payload_id BIGINT, zone_id BIGINT, received_at TIMESTAMP_NTZ, available BOOLEAN, "
    "current STRUCT<time: STRING, temperature_2m: DOUBLE, relative_humidity_2m: DOUBLE>, "
    "hourly STRUCT<time: ARRAY<STRING>, precipitation: ARRAY<DOUBLE>>"
)


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PAYLOAD_SCHEMA).json(folder)


def stream_payloads(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAYLOAD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def last_day_precipitation(hourly: Column, reference: Column) -> Column:
    """Sum of the samples of the 24 hours up to the reference; NULL samples and future hours are
    skipped. Without a reference every sample counts; without any sample the answer is NULL."""
    samples = F.arrays_zip(hourly["time"].alias("time"), hourly["precipitation"].alias("mm"))
    stamped = F.transform(samples, lambda s: F.struct(parse_iso(s["time"]).alias("at"), s["mm"].alias("mm")))
    day = F.make_dt_interval(F.lit(1))

    def total(end: Column) -> Column:
        used = F.filter(
            stamped,
            lambda s: s["mm"].isNotNull() & s["at"].isNotNull()
            & (end.isNull() | ((s["at"] <= end) & (s["at"] >= end - day))),
        )
        return F.aggregate(
            used,
            F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mm")),
            lambda acc, s: F.struct((acc["n"] + 1).alias("n"), (acc["mm"] + s["mm"]).alias("mm")),
            lambda acc: F.when(acc["n"] > 0, F.round(acc["mm"], 2)),
        )

    # The one-element array has the reference parsed once, not once per sample.
    return F.get(F.transform(F.array(parse_iso(reference)), total), F.lit(0))


def readings(payloads: DataFrame) -> DataFrame:
    """One row per payload: what the provider said, NULL for whatever it left out. The samples are parsed once."""
    ok = F.col("available")
    reading = lambda c: F.when(ok, c)
    return payloads.select("payload_id", "zone_id", "received_at", "available", once(
        temperature=reading(F.col("current.temperature_2m")),
        humidity=reading(F.col("current.relative_humidity_2m")),
        rainfall_24h=reading(last_day_precipitation(F.col("hourly"), F.col("current.time"))),
        observed_at=reading(F.col("current.time")),
    ))


def latest_per_zone(rows: DataFrame) -> DataFrame:
    """Newest reading of every zone, combined before the shuffle."""
    rest = [c for c in rows.columns if c != "zone_id"]
    return rows.groupBy("zone_id").agg(F.max_by(F.struct(*rest), F.struct("received_at", "payload_id")).alias("r")).select(
        "zone_id", "r.*"
    )


def feed_status(rows: DataFrame) -> DataFrame:
    """Time of the last successful reading and whether the latest attempt succeeded."""
    return rows.agg(
        F.max(F.when(F.col("available"), F.col("received_at"))).alias("last_refresh"),
        F.max_by("available", F.struct("received_at", "payload_id")).alias("available"),
    )
