"""Incremental ingestion: files dropped into a folder end up in the table exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talus.plans import ingestion

ROW_FILE, ROW_BLOCK = "_file", "_block"


def stream_csv(spark: SparkSession, folder: str, headers: list[str], files_per_batch: int = 1000) -> DataFrame:
    schema = ", ".join(f"`{h}` STRING" for h in headers)
    return (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
        .select("*", F.col("_metadata.file_path").alias(ROW_FILE), F.col("_metadata.file_block_start").alias(ROW_BLOCK))
    )


def ingest_batch(rows: DataFrame, batch: int, table: str, source_id: str, category: str) -> None:
    """Same rules as file ingestion; the batch replaces its own partition when it is run again."""
    raw = rows.withColumn("_order", F.struct(ROW_FILE, ROW_BLOCK, F.monotonically_increasing_id().alias("at"))).drop(ROW_FILE, ROW_BLOCK)
    ingestion.store_rows(raw, source_id, category, table, f"stream-{batch}")


def start(rows: DataFrame, table: str, source_id: str, category: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, batch: ingest_batch(df, batch, table, source_id, category)).start()
    )
