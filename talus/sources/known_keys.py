"""The keys a table already holds, kept beside it so that a batch need not read the stored rows.

`<table>_keys` holds 128 bits of hash per key (the record id, and the place and time of every row), in a folder per batch and in
it per source and bucket of the hash. A batch looks only into the buckets its own keys fall into, and reads two numbers
per key there; while the batch is small it is broadcast, so that the store is not shuffled. Keys are written after their rows:
a batch whose keys were not finished is read from its rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.runtime import broadcast_if_small, cut_lineage, folders

BUCKETS = 64
SCHEMA = "h1 BIGINT, h2 BIGINT, batch STRING, source_id STRING, bucket INT"


def _hashed(kind: str, *parts: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(kind), *parts).alias("h1"), F.xxhash64(*parts, F.lit(kind)).alias("h2"))


def _by_id(record_id: Column) -> Column:
    return _hashed("id", record_id)


def _by_place(lat: Column, lon: Column, date: Column) -> Column:
    # Zero has one sign, and no date is a date of its own.
    return _hashed("place", lat + F.lit(0.0), lon + F.lit(0.0), F.coalesce(date.cast("string"), F.lit("")))


def _bucketed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)).cast("int"))


def keys_of(stored: DataFrame, date: str) -> DataFrame:
    """(source_id, h1, h2, bucket): the keys that stored rows block. Every row blocks its place and time, also when it has a
    record id."""
    own = F.when(F.col("source_record_id") != "", _by_id(F.col("source_record_id")))
    place = _by_place(F.round("latitude", 6), F.round("longitude", 6), F.col(date))
    keys = stored.select("source_id", F.explode(F.array_compact(F.array(own, place))).alias("k")).select("source_id", "k.*")
    return _bucketed(keys).distinct()


@dataclass
class KnownKeys:
    """The keys of one source in a table, as a batch sees them: without those of its own earlier try."""

    spark: SparkSession
    table: str
    source_id: str
    batch: str
    date: str

    @property
    def root(self) -> str:
        return f"{self.table}_keys"

    def stored(self, buckets: list[int] | None = None) -> DataFrame:
        """(h1, h2) of the other batches, of some buckets only if given."""
        rows = {b for b in folders(self.spark, self.table, "batch=*")}
        kept = {b for b in folders(self.spark, self.root, "batch=*", finished=True)}
        mine = f"batch={quote(self.batch, safe='')}"
        keys = self.spark.createDataFrame([], "h1 BIGINT, h2 BIGINT")
        if kept - {mine}:
            found = self.spark.read.schema(SCHEMA).option("basePath", self.root).parquet(
                *[f"{self.root}/{b}" for b in sorted(kept - {mine})]).where(F.col("source_id") == self.source_id)
            if buckets is not None:
                found = found.where(F.col("bucket").isin(buckets))
            keys = keys.unionByName(found.select("h1", "h2"))
        if rows - kept - {mine}:
            fields = f"source_record_id STRING, latitude DOUBLE, longitude DOUBLE, {self.date} TIMESTAMP_NTZ, source_id STRING"
            loose = self.spark.read.schema(fields).option("basePath", self.table).parquet(
                *[f"{self.table}/{b}" for b in sorted(rows - kept - {mine})])
            keys = keys.unionByName(keys_of(loose.where(F.col("source_id") == self.source_id), self.date).select("h1", "h2"))
        return keys

    def unknown(self, firsts: DataFrame) -> DataFrame:
        """The rows (one per key: k_id, or k_lat, k_lon and k_date) whose key no other batch has stored. The rows are worked out
        once."""
        key = F.when(F.col("k_id").isNotNull(), _by_id(F.col("k_id"))).otherwise(_by_place(F.col("k_lat"), F.col("k_lon"), F.col("k_date")))
        keyed = cut_lineage(_bucketed(firsts.select("*", key.alias("_k")).select("*", "_k.h1", "_k.h2").drop("_k")))
        buckets = sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect())  # BUCKETS at most
        asked = broadcast_if_small(keyed.select("h1", "h2"))
        known = cut_lineage(self.stored(buckets).join(asked, ["h1", "h2"], "left_semi").distinct())
        return keyed.join(broadcast_if_small(known), ["h1", "h2"], "left_anti").drop("h1", "h2", "bucket")

    def remember(self, rows: DataFrame) -> None:
        """Store the keys of this batch's rows, one file per bucket; an earlier try of the batch is replaced."""
        keys_of(rows, self.date).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("source_id", "bucket").parquet(
            f"{self.root}/batch={quote(self.batch, safe='')}")
