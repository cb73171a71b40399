"""Sharding by proportional stratified interleaving.

The rows of every source are shuffled by a seeded hash and ranked; a row's place in the whole is its fractional rank
(rank - 1/2) / rows of the source. Cutting that order into pieces of equal length gives shards whose sources are mixed as
in the whole table. Ranks come from range partitions plus offsets, so a source with a third of all rows is spread as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.runtime import attach_to_groups, positions

SHARDS = 16
SEED = "interleave-1"


def interleave(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, source, key) -> (row, shard, slot). Shards differ by one row at most; slots count from 0 in each. `key`
    orders a source's rows; rows with equal keys may change places with each other. NULL is a source like any other. No
    rows: no output; fewer rows than shards: some shards stay empty."""
    ranked = positions(rows, [F.col("key")], ["source"], "place")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    mixed = attach_to_groups(ranked, sizes, ["source"]).withColumn("fraction", (F.col("place") - 0.5) / F.col("n"))
    placed = positions(mixed.select("row", "source", "key", "fraction"), [F.col("fraction"), F.col("source"), F.col("key")],
                       name="place")
    n = rows.count()
    return placed.withColumn("shard", F.expr(f"cast((place - 1) * {shards} div {max(1, n)} AS int)")).select(
        "row", "shard", (F.col("place") - 1 - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """Law `rows`: the counts of the shards are at most one apart. A NULL text has size 1 and no checksum."""
    bytes_ = F.col("text").cast("binary")
    crc = F.crc32(bytes_)
    rows = docs.select(
        F.struct("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                 crc.alias("text_crc32")).alias("row"),
        "source", F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id"), crc).cast("binary")).alias("key"))
    return interleave(rows).select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                   F.lit(None).cast("int").alias("grown_shard"))


SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i)
         AS entries FROM (SELECT unnest(range(256)) AS i)
), sized AS (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size,
         CASE WHEN text IS NOT NULL THEN xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda c, b: xor(c // 256, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) END AS text_crc32
  FROM documents, crc_table
), keyed AS (
  SELECT *, md5(concat_ws('|', '{SEED}', doc_id, text_crc32)) AS key FROM sized
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction
  FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, key) - 1 AS p, count(*) OVER () AS n FROM ranked
), cut AS (SELECT *, p * {SHARDS} // n AS s FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, s::INTEGER AS shard,
       (p - (s * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
