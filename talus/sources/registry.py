"""Provenance: source registry, ingestion runs, public projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus import vocab
from talus.functions.text import file_name
from talus.runtime import folders
from talus.sources.files import checksums

RUN_COUNTS = ["total_records", "valid_records", "invalid_records", "inserted", "duplicates"]
RUN_STATES = ("processing", "processed", "failed")
PUBLIC_SUMMARY = ["source_id", "name", "category", "configured", "processed", "last_status"]


def register(existing: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Upsert by source_id into a new snapshot. A re-registered source starts over as `registered`
    but keeps its first registered_at. Unknown categories are refused."""
    checked = new.withColumn(
        "category",
        F.when(F.col("category").isin(*vocab.SOURCE_CATEGORIES), F.col("category")).otherwise(
            F.raise_error(F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("NULL"))))
        ),
    )
    incoming = checked.select(F.col("source_id"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != "source_id"], F.lit(True).alias("_new"))
    joined = existing.join(incoming, "source_id", "full_outer")
    fresh = F.coalesce("_new", F.lit(False))
    columns = [F.col("source_id")]
    for c in existing.columns:
        if c in ("source_id", "last_status", "last_error", "registered_at"):
            continue
        columns.append(F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c))
    return joined.select(
        *columns,
        F.when(fresh, "registered").otherwise(F.col("last_status")).alias("last_status"),
        F.when(~fresh, F.col("last_error")).alias("last_error"),
        F.coalesce("registered_at", F.when(fresh, at)).alias("registered_at"),
    )


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row about the file or files of a path: bare name, size, SHA-256. Of several files: how many, their sizes added up, and
    the hash of their hashes in order of their names."""
    found = checksums(spark, path)
    one = F.count("*") == 1
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_name", "checksum_sha256"))), lambda x: x["checksum_sha256"]), "\n")
    return found.agg(
        F.when(one, F.min("file_name")).otherwise(F.concat(F.count("*").cast("string"), F.lit(" files"))).alias("file_name"),
        F.sum("file_size_bytes").alias("file_size_bytes"),
        F.when(one, F.min("checksum_sha256")).otherwise(F.sha2(listed, 256)).alias("checksum_sha256"))


REGISTERED = ("source_id STRING, name STRING, category STRING, file_name STRING, file_size_bytes BIGINT, checksum_sha256 STRING, "
              "last_status STRING, last_error STRING, registered_at TIMESTAMP_NTZ")


def registered(spark: SparkSession, sources: str, source_id: str) -> DataFrame:
    """The stored registration of a source; no row if there is none."""
    if not folders(spark, sources, f"source_id={source_id}"):
        return spark.createDataFrame([], REGISTERED)
    return spark.read.schema(REGISTERED).parquet(sources).where(F.col("source_id") == source_id)


def register_file(spark: SparkSession, sources: str, source_id: str, name: str, category: str, path: str, at: Column) -> DataFrame:
    """The registration of a source by its file, over the stored one (see register): category checked, name, size and checksum
    taken anew, the first registered_at kept."""
    new = file_facts(spark, path).select(F.lit(source_id).alias("source_id"), F.lit(name).alias("name"), F.lit(category).alias("category"), "*")
    return register(registered(spark, sources, source_id), new, at)


def run_row(source_id: str, summary: DataFrame, started_at: Column, completed_at: Column,
            error: str | None = None) -> DataFrame:
    """The finished run of one source; a run with an error counts as failed."""
    return summary.select(
        F.lit(source_id).alias("source_id"),
        *[c for c in ("total_records", "valid_records", "invalid_records", "inserted", "duplicates") if c in summary.columns],
        started_at.alias("started_at"), completed_at.alias("completed_at"),
        F.lit("failed" if error else "processed").alias("status"),
        F.lit(error).cast("string").alias("error_summary"),
    )


def run_state(spark: SparkSession, run_id: str, source_id: str, started_at: Column, status: str,
              summary: DataFrame | None = None, error: str | None = None) -> DataFrame:
    """One run of a source at any point of its life: `processing`, `processed` or `failed`. Counts are NULL until known."""
    if status not in RUN_STATES:
        raise ValueError(f"unknown run status {status}")
    row = spark.range(1).select(F.lit(run_id).alias("id"), F.lit(source_id).alias("source_id")) if summary is None else summary.select(
        F.lit(run_id).alias("id"), F.lit(source_id).alias("source_id"), *RUN_COUNTS)
    counts = [] if summary is not None else [F.lit(None).cast("long").alias(c) for c in RUN_COUNTS]
    ended = F.current_timestamp().cast("timestamp_ntz") if status != "processing" else F.lit(None).cast("timestamp_ntz")
    return row.select("*", *counts).select(
        "id", "source_id", *[F.col(c).cast("long").alias(c) for c in RUN_COUNTS], started_at.alias("started_at"),
        ended.alias("completed_at"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error_summary"))


def current_status(runs: DataFrame) -> DataFrame:
    """Status of every source = its latest run; `processed` only after a success."""
    last = F.max_by(F.struct("id", "status", "error_summary", "started_at"), F.struct("started_at", "id"))
    return runs.groupBy("source_id").agg(last.alias("r")).select(
        "source_id", F.col("r.id").alias("run_id"), F.col("r.status").alias("last_status"),
        F.col("r.error_summary").alias("last_error"), F.col("r.started_at").alias("started_at"),
        (F.col("r.status") == "processed").alias("processed"),
    )


def public_summary(sources: DataFrame) -> DataFrame:
    return sources.select(*[c for c in PUBLIC_SUMMARY if c in sources.columns])


def public_detail(sources: DataFrame) -> DataFrame:
    """Adds the bare file name; the path itself is never shown."""
    return sources.select(
        *[c for c in PUBLIC_SUMMARY if c in sources.columns], file_name(F.col("file_path")).alias("local_file_name")
    )
