"""Composite ingestion jobs: validate an inventory, ingest events, ingest rainfall, inspect a file."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talus import vocab
from talus.functions.quality import event_completeness
from talus.operators import ingest, polygons
from talus.runtime import broadcast_if_small, cut_lineage, positions, stored
from talus.sources import files, registry, sinks
from talus.sources.known_keys import KnownKeys


@dataclass
class Ingested:
    """rows: every input row with its reject reasons; accepted: rows to store; summary: the counts."""

    rows: DataFrame
    accepted: DataFrame
    summary: DataFrame

    @property
    def rejected(self) -> DataFrame:
        return ingest.rejected(self.rows)


def numbered(raw: DataFrame) -> DataFrame:
    """Rows with their consecutive position in the file, from 0.

    Rows that were read from files know their file, split and place: the rows of every split are counted, and the rows before a
    split are added to the places inside it. Other rows are ranked by their `_order`.
    """
    order = raw.schema["_order"].dataType
    if not isinstance(order, StructType) or order.names != files.ORDER_FIELDS:
        return positions(raw, [F.col("_order")], name="index", keep=stored).withColumn("index", F.col("index") - 1)
    split = ["_order.file", "_order.block"]
    sizes = raw.groupBy(*[F.col(c) for c in split]).agg(F.min("_order.at").alias("first"), F.count("*").alias("rows"))
    # One row per split of the files; the window runs over those.
    before = sizes.select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), "first",
        F.expr("coalesce(sum(rows) OVER (ORDER BY file, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("before"))
    same = (F.col("_order.file") == F.col("_file")) & (F.col("_order.block") == F.col("_block"))
    return raw.join(broadcast_if_small(before), same).withColumn("index", F.col("_order.at") - F.col("first") + F.col("before")).drop(
        "_file", "_block", "first", "before")


def validate_inventory(raw: DataFrame, source_name: str) -> tuple[DataFrame, DataFrame]:
    """All records with errors, and the valid ones with completeness and missing features."""
    index = F.col("index") if "index" in raw.columns else None
    rows = raw if index is not None else numbered(raw)
    validated = ingest.validate_records(ingest.normalize_records(rows, source_name))
    return validated, ingest.with_completeness(validated.where(F.size("errors") == 0))


def read_events(raw: DataFrame) -> DataFrame:
    """Event rows with the reasons for which they are rejected."""
    return ingest.reject_reasons(ingest.read_events(raw, files.column_map(raw.columns, vocab.EVENT_ALIASES)))


def read_rainfall(raw: DataFrame) -> DataFrame:
    """Rainfall rows with the reasons for which they are rejected."""
    return ingest.reject_reasons(ingest.read_rainfall(raw, files.column_map(raw.columns, vocab.RAINFALL_ALIASES)), rainfall=True)


def event_rows(fresh: DataFrame, source_id: str, states: DataFrame | None, districts: DataFrame | None) -> DataFrame:
    """Accepted events as they are stored: placed, with their completeness."""
    placed = polygons.fill_places(fresh, states, districts)
    place = F.coalesce("state", "district")
    return placed.select(
        "latitude", "longitude", "state", "district", "event_date", "event_type", "severity",
        F.lit(source_id).alias("source_id"), "source_record_id",
        event_completeness(F.col("event_date"), F.col("event_type"), F.col("severity"), place).cast("int").alias("data_quality_score"),
    )


def rainfall_rows(fresh: DataFrame, source_id: str) -> DataFrame:
    """Accepted rainfall readings as they are stored."""
    return fresh.select(
        F.lit(source_id).alias("source_id"), "source_record_id", "station_id", "observed_date", "latitude", "longitude",
        "rainfall_mm", F.lit(None).cast("string").alias("resolution"),
    )


def ingest_events(raw: DataFrame, source_id: str, stored: DataFrame | None = None, states: DataFrame | None = None,
                  districts: DataFrame | None = None) -> Ingested:
    rows = read_events(raw)
    fresh = ingest.accept(rows, stored, "event_date")
    return Ingested(rows, event_rows(fresh, source_id, states, districts), ingest.ingestion_summary(rows, fresh))


def ingest_rainfall(raw: DataFrame, source_id: str, stored: DataFrame | None = None) -> Ingested:
    rows = read_rainfall(raw)
    fresh = ingest.accept(rows, stored, "observed_date")
    return Ingested(rows, rainfall_rows(fresh, source_id), ingest.ingestion_summary(rows, fresh))


DATES = {"rainfall": "observed_date"}


def store_rows(raw: DataFrame, source_id: str, category: str, table: str, batch: str, states: DataFrame | None = None,
               districts: DataFrame | None = None) -> DataFrame:
    """Ingest the rows of one batch into a table and return the counts. The rows are parsed once: they are counted on their way
    to the accepted ones, which are stored before anything else is done with them."""
    spark = raw.sparkSession
    date = DATES.get(category, "event_date")
    known = KnownKeys(spark, table, source_id, batch, date)
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(F.size("reasons") > 0).alias("bad")]
    if category == "rainfall":
        rows = read_rainfall(raw).observe(seen, *counts)
        accepted = rainfall_rows(ingest.accept(rows, known, date), source_id)
    else:
        rows = read_events(raw).observe(seen, *counts)
        accepted = event_rows(ingest.accept(rows, known, date), source_id, states, districts)
    sinks.append_batch(accepted, table, batch)
    stored = spark.read.schema(accepted.schema).parquet(f"{table}/batch={quote(batch, safe='')}")
    known.remember(stored)
    found, inserted = seen.get, stored.count()
    return spark.createDataFrame(
        [(found["total"], inserted, found["bad"], inserted, found["total"] - found["bad"] - inserted)],
        "total_records long, valid_records long, invalid_records long, inserted long, duplicates long")


def ingest_file(spark: SparkSession, path: str, source_id: str, category: str, table: str, batch: str,
                states: DataFrame | None = None, districts: DataFrame | None = None,
                at: Column | None = None) -> DataFrame:
    """Read, ingest and append one file; returns the finished run row. Running it again adds nothing."""
    started = at if at is not None else _now()
    raw = files.read_dataset(spark, path, quoted_newlines=category != "rainfall")
    summary = store_rows(raw, source_id, category, table, batch, states, districts)
    return registry.run_row(source_id, summary, started, at if at is not None else _now())


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")


def tracked_file(spark: SparkSession, path: str, source_id: str, category: str, table: str, batch: str, runs: str,
                 sources: str | None = None, name: str | None = None, registered_as: str | None = None, **options) -> None:
    """ingest_file with its run on record in the table `runs`: processing from the start, then processed with its counts, or
    failed with the error, which is raised again. With a table `sources` the source is registered first, with the name, size and
    checksum of its file, and carries the run's outcome afterwards."""
    started = _now()

    def state(status: str, **facts) -> None:
        sinks.write_run(registry.run_state(spark, batch, source_id, started, status, **facts), runs)
        if sources is not None and status != "processing":
            row = cut_lineage(registry.registered(spark, sources, source_id))
            sinks.write_source(row.withColumns({"last_status": F.lit(status), "last_error": F.lit(facts.get("error")).cast("string")}), sources)

    state("processing")
    try:
        if sources is not None:
            row = registry.register_file(spark, sources, source_id, name or source_id, registered_as or category, path, started)
            sinks.write_source(cut_lineage(row), sources)
        summary = ingest_file(spark, path, source_id, category, table, batch, **options)
        state("processed", summary=summary)
    except Exception as error:
        state("failed", error=str(error)[:500])
        raise


def inspect(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row count, missing cells per column, extent."""
    return df.agg(F.count("*").alias("records")), ingest.missing_per_column(df), ingest.bounding_box(df)


SAMPLE_ROWS = 3


def inspect_file(spark: SparkSession, path: str) -> DataFrame:
    """One row about an inventory file: its type and, of GeoJSON, the geometry type (of the first feature that has one); rows, columns, the columns taken for latitude,
    longitude and date, missing cells per column where there are any, the first rows, and the extent."""
    kind = files.file_type(path)
    df = files.read_dataset(spark, path, quoted_newlines=True)
    names = [c for c in df.columns if not c.startswith("_")]
    found = files.column_map(names)
    geometry = None
    if kind == "geojson":
        first = files.read_features(spark, path).where("geometry_type IS NOT NULL").agg(F.min_by("geometry_type", F.struct("file", "at"))).first()[0]
        geometry = first or "unknown"
    gaps = ingest.missing_per_column(df).where("missing > 0").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "missing")))).alias("missing_cells"))
    head = df.orderBy("_order").limit(SAMPLE_ROWS).select("_order", F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}).alias("row"))
    sample = head.agg(F.transform(F.sort_array(F.collect_list(F.struct("_order", "row"))), lambda x: x["row"]).alias("sample_rows"))
    box = ingest.bounding_box(df)
    text = lambda value: F.lit(value).cast("string")
    return df.agg(F.count("*").alias("records")).select(
        text(kind).alias("file_type"), text(geometry).alias("geometry_type"), "records",
        F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("columns"),
        *[text(found[f]).alias(f"{f}_column") for f in ("latitude", "longitude", "date")],
        gaps.scalar().alias("missing_cells"), sample.scalar().alias("sample_rows"),
        *[box.select(c).scalar().alias(c) for c in box.columns])
