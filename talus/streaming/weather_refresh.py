"""The refresh cycle as a stream: new weather -> zones -> scores -> alerts -> audit log.

State is kept per zone as changes: a micro-batch writes the zones that moved, the alerts it opened and the zones whose alerts it
closed, each into a folder of its own batch, and then its commit, a one-row file that makes the batch count. Readers take the
newest committed version: the last full copy and the changes since. Every `COMPACT_EVERY` batches a batch writes a full copy.
A batch starts from the version before it and only writes its own folders, so running it again gives the same files, and one
that was cut off leaves nothing that counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talus.functions import risk
from talus.operators import scoring
from talus.runtime import broadcast_if_small, cut_lineage, spread
from talus.sources import weather

ALERT_COLUMNS = ("zone_id BIGINT, title STRING, message STRING, severity STRING, status STRING, is_active BOOLEAN, "
                 "risk_score DOUBLE, reason STRING, created_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ")
COMMIT = "version INT, base INT, refreshed_at TIMESTAMP_NTZ"
COMPACT_EVERY = 24


@dataclass
class RefreshTables:
    """The tables one refresh stream maintains. Version 0 is the start; batch n makes version n + 1."""

    root: str

    def part(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def _copy(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/version={version}"

    def start(self, zones: DataFrame, open_alerts: DataFrame | None = None) -> None:
        if open_alerts is None:
            open_alerts = zones.sparkSession.createDataFrame([], ALERT_COLUMNS)
        self._write_copy(0, zones, open_alerts.withColumn("opened_in", F.lit(-1)))
        self._commit(zones.sparkSession, 0, 0, None)

    def _write_copy(self, version: int, zones: DataFrame, alerts: DataFrame) -> None:
        zones.write.mode("overwrite").parquet(self._copy("zones", version))
        alerts.write.mode("overwrite").parquet(self._copy("open_alerts", version))

    def _commit(self, spark: SparkSession, version: int, base: int, at) -> None:
        row = spark.createDataFrame([(version, base, at)], COMMIT).coalesce(1)
        row.write.mode("overwrite").json(f"{self.root}/commits/of={version}")

    def _committed(self, spark: SparkSession, version: int):
        row = spark.read.schema(COMMIT).json(f"{self.root}/commits/of={version}").first()
        if row is None:
            raise ValueError(f"version {version} is not committed")
        return row

    def _changes(self, spark: SparkSession, name: str, base: int, version: int) -> DataFrame:
        """The rows of the batches that lead from `base` to `version`, with `batch`."""
        paths = [self.part(name, b) for b in range(base, version)]
        return spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def zones(self, spark: SparkSession, version: int) -> DataFrame:
        """All zones as of a committed version."""
        commit = self._committed(spark, version)
        full = spark.read.parquet(self._copy("zones", commit["base"]))
        if version > commit["base"]:
            rows = self._changes(spark, "zone_changes", commit["base"], version)
            newest = rows.groupBy("id").agg(F.max_by(F.struct(*full.columns), "batch").alias("z")).select("z.*")
            newest = cut_lineage(newest)
            full = full.join(broadcast_if_small(newest.select("id")), "id", "left_anti").unionByName(newest)
        if commit["refreshed_at"] is None:
            return full
        # Every zone that can be scored is recomputed by every batch, so that time is kept once, in the commit.
        guard = risk.needs_guard(F.col("source_type"), F.col("terrain_data_real"))
        return full.withColumn("updated_at", F.when(guard, F.col("updated_at")).otherwise(F.lit(commit["refreshed_at"]).cast("timestamp_ntz")))

    def _open_rows(self, spark: SparkSession, version: int) -> DataFrame:
        commit = self._committed(spark, version)
        rows = spark.read.parquet(self._copy("open_alerts", commit["base"]))
        if version == commit["base"]:
            return rows
        opened = self._changes(spark, "opened_alerts", commit["base"], version).withColumnRenamed("batch", "opened_in")
        closed = self._changes(spark, "closed_zones", commit["base"], version).groupBy("zone_id").agg(F.max("batch").alias("closed_in"))
        rows = rows.unionByName(opened).join(closed, "zone_id", "left")
        return rows.where(F.col("opened_in") >= F.coalesce("closed_in", F.lit(-1))).drop("closed_in")

    def open_alerts(self, spark: SparkSession, version: int) -> DataFrame:
        """The alerts that are open as of a committed version."""
        return self._open_rows(spark, version).drop("opened_in")


def latest_version(spark: SparkSession, tables: RefreshTables) -> int:
    """The newest committed version."""
    return spark.read.schema(COMMIT).json(f"{tables.root}/commits/*").agg(F.max("version")).first()[0]


def refresh_batch(payloads: DataFrame, batch: int, tables: RefreshTables, triggered_by: str = "stream_refresh",
                  compact_every: int = COMPACT_EVERY) -> None:
    """One cycle over all zones. Zones without a usable reading are still scored; nothing is stored
    for an unavailable reading. Every payload is parsed once."""
    spark = payloads.sparkSession
    commit = tables._committed(spark, batch)
    readings = cut_lineage(weather.readings(spread(payloads)))
    received = readings.agg(F.max("received_at")).first()[0]
    at = F.lit(received).cast("timestamp_ntz")
    readings.where("available").write.mode("overwrite").parquet(tables.part("observations", batch))
    zones = tables.zones(spark, batch)
    overlaid = scoring.overlay_weather(zones, weather.latest_per_zone(readings))
    # One row per zone, stored once because several tables are written from it.
    before = F.struct(*[c for c in zones.columns if c != "updated_at"]).alias("before")
    old = zones.select(F.col("id").alias("_id"), before)
    scored = cut_lineage(scoring.score_zones(overlaid).join(old, F.col("id") == F.col("_id")).drop("_id"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"before.{c}")) for c in zones.columns if c != "updated_at"])
    moved = scored.where(~same).select(*zones.columns)
    moved.write.mode("overwrite").parquet(tables.part("zone_changes", batch))
    scored = scored.drop("before")
    alerts = tables.open_alerts(spark, batch)
    decided = cut_lineage(scoring.decide(scored, alerts))
    scoring.new_alerts(decided, at).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz")).write.mode("overwrite").parquet(
        tables.part("opened_alerts", batch))
    closing = cut_lineage(decided.where("alert_updated").select(F.col("id").alias("zone_id")))
    closing.write.mode("overwrite").parquet(tables.part("closed_zones", batch))
    closed = alerts.join(broadcast_if_small(closing), "zone_id", "left_semi").withColumns(
        {"status": F.lit("resolved"), "is_active": F.lit(False), "resolved_at": at})
    closed.write.mode("overwrite").parquet(tables.part("closed_alerts", batch))
    scoring.audit_rows(scored, triggered_by, at).write.mode("overwrite").parquet(tables.part("risk_log", batch))
    summary(decided).write.mode("overwrite").parquet(tables.part("results", batch))
    base = commit["base"]
    if batch + 1 - base >= compact_every:
        tables._commit(spark, batch + 1, base, received)
        full, rows = cut_lineage(tables.zones(spark, batch + 1)), cut_lineage(tables._open_rows(spark, batch + 1))
        base = batch + 1
        tables._write_copy(base, full, rows)
    tables._commit(spark, batch + 1, base, received)


def refresh_result(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Zones, refreshed, without weather, rescored, alerts created in one cycle."""
    return summary(scoring.decide(scored, alerts))


def summary(decided: DataFrame) -> DataFrame:
    seen = F.coalesce("weather_available", F.lit(False))
    return decided.agg(
        F.count("*").alias("total_zones"),
        F.count_if(seen).alias("updated"),
        F.count_if(~seen).alias("weather_unavailable"),
        F.count("*").alias("risk_updated"),
        F.count_if("alert_created").alias("alerts_generated"),
    )


def start(payloads: DataFrame, tables: RefreshTables, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: refresh_batch(df, batch, tables)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 minutes")
    return writer.start()
