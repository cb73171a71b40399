"""Writers: processed records with metadata, feature sets, idempotent appends."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published column order.
RECORD_COLUMNS = [
    "location_id", "latitude", "longitude", "event_date", "rainfall_24h", "rainfall_7d", "humidity", "temperature",
    "elevation", "slope", "vegetation", "historical_landslide", "risk_level", "source_type", "source_name",
    "data_quality_score", "missing_features",
]


def record_table(records: DataFrame) -> DataFrame:
    """The published column order; the list of missing features as one ;-separated text."""
    return records.withColumn("missing_features", F.array_join("missing_features", ";")).select(*RECORD_COLUMNS)


def record_metadata(validated: DataFrame, scored: DataFrame, source_file: str | None, limitations: list[str] | None = None) -> DataFrame:
    """One row: counts, the distinct missing features in sorted order, the source's bare file name, the time of
    processing, and the caller's notes on what the data cannot tell."""
    missing = scored.select(F.explode("missing_features").alias("f")).agg(F.sort_array(F.collect_set("f")).alias("m"))
    bad = F.size("errors") > 0
    return validated.agg(
        F.count("*").alias("total_input_records"),
        F.count_if(~bad).alias("valid_records"),
        F.count_if(bad).alias("invalid_records"),
    ).select(
        F.regexp_extract(F.lit(source_file or ""), r"[^/]+$", 0).alias("source_landslide_file"),
        "*",
        missing.scalar().alias("missing_features_observed"),
        F.array(*[F.lit(x) for x in limitations or []]).cast("array<string>").alias("limitations"),
        F.current_timestamp().alias("processing_timestamp"),
    )


def write_records(validated: DataFrame, scored: DataFrame, folder: str, source_file: str | None = None,
                  limitations: list[str] | None = None) -> None:
    record_table(scored).write.mode("overwrite").option("header", True).csv(f"{folder}/records")
    record_metadata(validated, scored, source_file, limitations).write.mode("overwrite").json(f"{folder}/metadata")


def write_features(rows: DataFrame, metadata: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    metadata.write.mode("overwrite").json(f"{folder}/metadata")


def append_batch(rows: DataFrame, table: str, batch: str) -> None:
    """Append one batch to a table partitioned by batch and source.

    The batch has a folder of its own and replaces all of it when it is run again, so a retried batch cannot store its
    rows twice, nor leave rows of an earlier try. Rows are brought together by source before they are written, a source
    with many rows in several files.
    """
    rows.hint("rebalance", "source_id").write.mode("overwrite").partitionBy("source_id").parquet(f"{table}/batch={quote(batch, safe='')}")


def write_source(source: DataFrame, sources: str) -> None:
    """Store the registration of one source; a later one of the same source replaces it."""
    source.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(sources)


def write_run(run: DataFrame, runs: str) -> None:
    """Store the state of one run; a later state of the same run replaces it."""
    run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").parquet(runs)


def write_negatives(points: DataFrame, path: str) -> DataFrame:
    """Store sampled points once and hand back the stored set; later jobs must read this one."""
    points.write.mode("overwrite").parquet(path)
    return points.sparkSession.read.parquet(path)
