"""Exact top-k search by inner product of integer vectors.

Candidates are dealt into shards and queries into bands by hash; every (shard, band) is one task that multiplies tiles of
its queries with its candidates and selects the best k of every tile row. The per-query lists of the shards are then
merged in a tree of bounded fan-in, so that no task holds more than `FAN_IN` lists of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
BAND_ROWS = 4_096
TILE_ROWS = 256
FAN_IN = 64
K = 5
QUERY_EVERY = 50
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): floor(256 * x) per component. Rows with a NULL id, a NULL vector, or a NULL or non-finite
    component take no part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while no sum can reach 2^53, whole numbers of any size otherwise (scores past a
    long end at its limits)."""
    largest = lambda m: float(np.abs(m.astype(float)).max(initial=0))
    if largest(queries) * largest(candidates) * max(1, queries.shape[1]) < _EXACT:
        return queries.astype(float) @ candidates.astype(float).T
    return np.clip(queries.astype(object) @ candidates.astype(object).T, -_LONG, _LONG)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k largest scores of a row, ties to the smaller id; `ids` ascend; rows of the query's id are out."""
    a, b = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    places = np.concatenate([np.arange(a), np.arange(b, len(ids))])
    left = scores[places]
    if len(left) > k:
        limit = np.sort(left)[-k] if left.dtype == object else np.partition(left, len(left) - k)[len(left) - k]
        above, level = np.flatnonzero(left > limit), np.flatnonzero(left == limit)
        chosen = np.concatenate([above, level[:k - len(above)]])
        places, left = places[chosen], left[chosen]
    if left.dtype == object:
        return np.array(sorted(places, key=lambda p: (-scores[p], ids[p])), dtype=int)
    return places[np.lexsort((ids[places], -left))]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS,
           band_rows: int = BAND_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank, vec_id, score) for every distinct query row (vec_id, vector) against all rows of `vectors` with
    another vec_id. Shorter vectors count as filled up with zeros. Repeated candidate rows each have a place; a repeated
    query row is answered once. Fewer than k candidates: all of them."""
    n, nq = vectors.count(), queries.count()
    shards, bands = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(nq / band_rows))
    deal = lambda seed, parts: F.pmod(F.xxhash64("vec_id", "vector", F.lit(seed)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = vectors.select("vec_id", "vector", deal("shard", shards).alias("shard")).withColumn("band", each(bands))
    # New names: a cogroup of two frames of one origin needs columns that differ.
    right = queries.select("vec_id", "vector").dropDuplicates().select(
        F.col("vec_id").alias("own"), F.col("vector").alias("asked"), F.xxhash64("vector").alias("which"),
        deal("band", bands).alias("q_band")).withColumn("q_shard", each(shards))

    def products(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "which": [], "shard": [], "vec_id": [], "score": []}
        if len(candidates) and len(asked):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids = candidates["vec_id"].to_numpy()
            width = max(max(map(len, candidates["vector"])), max(map(len, asked["asked"])))
            matrix = _matrix(candidates["vector"], width)
            shard = int(candidates["shard"].iloc[0])
            for i in range(0, len(asked), TILE_ROWS):
                tile = asked.iloc[i:i + TILE_ROWS]
                scores = _products(_matrix(tile["asked"], width), matrix)
                for own, which, row in zip(tile["own"], tile["which"], scores):
                    places = best(row, ids, own, k)
                    out["query_id"] += [own] * len(places)
                    out["which"] += [which] * len(places)
                    out["shard"] += [shard] * len(places)
                    out["vec_id"] += [int(v) for v in ids[places]]
                    out["score"] += [int(s) for s in row[places]]
        return pd.DataFrame(out).astype("int64")

    found = left.groupBy("shard", "band").cogroup(right.groupBy("q_shard", "q_band")).applyInPandas(
        products, "query_id long, which long, shard long, vec_id long, score long")
    lists = found.select("query_id", "which", "shard", F.struct((-F.col("score")).alias("below"), "vec_id").alias("hit"))
    lists = lists.groupBy("query_id", "which", "shard").agg(F.collect_list("hit").alias("top"))
    held = shards
    while held > 1:
        held = math.ceil(held / fan_in)
        lists = lists.groupBy("query_id", "which", F.floor(F.col("shard") / fan_in).alias("shard")).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    ranked = lists.select("query_id", F.posexplode(F.slice(F.sort_array("top"), 1, k)).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.below")).alias("score"))


def is_query(vec_id: Column) -> Column:
    return vec_id % QUERY_EVERY == 0


def digest(embeddings: DataFrame) -> DataFrame:
    vectors = quantized(embeddings)
    return search(vectors, vectors.where(is_query(F.col("vec_id"))))


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
