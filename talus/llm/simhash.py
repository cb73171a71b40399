"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into `BLOCKS` blocks. Two fingerprints at `DISTANCE` or fewer differing bits agree on at least
BLOCKS - DISTANCE of them, so they meet in a bucket for some choice of that many blocks; pairs that meet are verified.
Equal fingerprints are one node throughout. A bucket of more than `BUCKET` nodes is not paired up: its nodes are looked up
by all fingerprints one bit away instead. Two nodes are within two bits exactly when they share such a neighbour (or are
neighbours), and all nodes around one neighbour are within two bits of each other, so linking each to the smallest of
them loses no connection and costs 65 rows per node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from talus.llm.common import row_column, small_batches
from talus.operators.cluster import connected_components
from talus.runtime import attach_to_groups, cut_lineage

SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
BUCKET = 48
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    pairs = list(zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()))
    for at in range(0, len(pairs), 1 << 16):
        part = pairs[at:at + (1 << 16)]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_ = np.flatnonzero(2 * counts > len(pairs))
    return sum(1 << int(i) for i in set_)


@pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(np.array([fingerprint(bytes(t)) for t in batch], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs -> (row, print): a NULL text has the fingerprint of an empty one."""
    return small_batches(docs).select(row_column(docs)).withColumn(
        "print", _fingerprints(F.coalesce(F.col("row.text").cast("binary"), F.lit(b""))))


def _keys(print_: Column, blocks: int, distance: int) -> Column:
    """One key per choice of blocks that must agree: (choice, the bits of those blocks)."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [sum(c) for c in combinations(masks, blocks - distance)]
    return F.array(*[F.struct(F.lit(i).alias("choice"), print_.bitwiseAND(F.lit(signed(m))).alias("bits"))
                     for i, m in enumerate(chosen)])


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those that a chain of pairs within `distance` bits
    connects. The way for crowded buckets rests on a distance of two."""
    if distance != 2:
        raise ValueError("crowded buckets are solved for a distance of two")
    keyed = prints.select("print", F.explode(_keys(F.col("print"), blocks, distance)).alias("key")).select("print", "key.*")
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    placed = keyed.join(sizes, ["choice", "bits"])
    small = placed.where(F.col("members") <= bucket).groupBy("choice", "bits").agg(F.collect_list("print").alias("all"))
    pairs = small.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter(
        "all", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= distance))).alias("b"))
    around = F.concat(F.array(F.col("print")), F.array(*[
        F.col("print").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]))
    crowded = placed.where(F.col("members") > bucket).select("print").distinct()
    near = crowded.select("print", F.explode(around).alias("near"))
    least = near.groupBy("near").agg(F.min("print").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).select("near", "a")
    stars = near.join(least, "near").where(F.col("print") != F.col("a")).select("a", F.col("print").alias("b"))
    return pairs.union(stars).distinct()


def reached(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (print) -> (print, class) for those linked to another: the smallest fingerprint of their chain."""
    edges = cut_lineage(links(prints))
    touched = edges.select("a").union(edges.select(F.col("b").alias("a"))).distinct().toDF("node")
    return connected_components(touched, edges).toDF("print", "class")


def classes(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, print, class, component_id). `class` is the smallest fingerprint reachable from the document's own,
    `component_id` the smallest doc_id of the class; NULL ids count only where a class has no other. Fingerprints are worked out
    once and stored with the ids; a NULL text has that of an empty one; repeated rows stay repeated. Without rows, none."""
    marked = cut_lineage(with_fingerprint(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "print"))
    narrow = cut_lineage(marked.groupBy("print").agg(F.min("doc_id").alias("first")))
    labelled = narrow.join(reached(narrow.select("print")), "print", "left").withColumn("class", F.coalesce("class", "print"))
    firsts = labelled.groupBy("class").agg(F.min("first").alias("component_id"))
    named = attach_to_groups(labelled.select("print", "class"), firsts, ["class"])
    return marked.join(named.select(F.col("print").alias("_print"), "class", "component_id"),
                       F.col("print").eqNullSafe(F.col("_print"))).drop("_print")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row, by `classes`."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
