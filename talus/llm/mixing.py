"""Mixing sources to target word counts with a multivariate-hypergeometric splitting tree.

Targets share out `FACTOR` times all words by weight, none above `CAP` times its source. The documents of a source are
drawn in a seeded order, the whole ones of a first round and then of a second, until the target is met as nearly as
whole documents allow: documents of more than 1/64 of their source are drawn first, by their share of the target, and
the small ones make up the rest exactly to half a small document. Each source's draw is cut into blocks of equal
ranges of the hash key, whose words are about equal in number only for many documents a block. A binary tree splits the sources' block quotas among the output shards: at every node the left half's part of
each quota is a multivariate hypergeometric draw. Blocks are permuted within their source, each shard takes the run of
permuted blocks that its quota says, and orders its copies by a hash.

Only per-source numbers (a few per source) pass the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import row_column, word_count
from talus.runtime import cut_lineage, running_sums

WEIGHTS = (5, 2, 1)
FACTOR = 1.5
CAP = 2
SHARDS = 16
PIECES = 64
BLOCK_WORDS = 2048
LARGE = 64          # a document over 1/LARGE of its source is large
SEED = 20240607


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, cap: float = CAP) -> list[float]:
    """Words wanted of every source: `factor` times the total by weight (repeating over the sources in order), what would
    pass `cap` times a source's size shared out among the others by weight until none is above."""
    want = [0.0] * len(sizes)
    left, open_ = factor * sum(sizes), set(range(len(sizes)))
    while open_:
        share = left / sum(weights[i % len(weights)] for i in open_)
        full = {i for i in open_ if share * weights[i % len(weights)] > cap * sizes[i]}
        if not full:
            for i in open_:
                want[i] = share * weights[i % len(weights)]
            break
        for i in full:
            want[i] = float(cap * sizes[i])
        left -= sum(want[i] for i in full)
        open_ -= full
    return want


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts whose columns sum to the quotas; shards' totals differ by the tree's rounding."""
    random = np.random.default_rng(seed)

    def divide(held: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [held]
        total = int(held.sum())
        left = random.multivariate_hypergeometric(held, total * (n // 2) // n, method="marginals")
        return divide(left, n // 2) + divide(held - left, n - n // 2)

    return np.array(divide(np.asarray(quotas, np.int64), shards)).reshape(shards, len(quotas))


def _by_source(rows: DataFrame, facts: list[tuple], schema: str) -> DataFrame:
    """Attach per-source facts (first field: the source) to the rows; one row per source."""
    small = rows.sparkSession.createDataFrame(facts, "_source string, " + schema)
    return rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _sized(docs: DataFrame) -> DataFrame:
    """docs -> (row, source, size, key): `key` is the seeded order of a source's documents, uniform over the longs."""
    return docs.select(row_column(docs), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                       F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("key"))


def _last_keys(summed: DataFrame, small: int, facts: dict) -> dict:
    """Per source of one size class: the last key drawn in each round and the words drawn. `facts`: source -> (words of
    the line, where it starts in the running sum, words wanted). A document is drawn in round n if its middle, n lines
    further on, lies before the wanted length."""
    placed = _by_source(summed.where(F.col("small") == small), [(s, *f) for s, f in facts.items()],
                        "line long, line_start long, wanted double")
    middle = F.col("upto") - F.col("line_start") - F.col("size") / 2
    inside = [(F.col("line") > 0) & (middle + n * F.col("line") < F.col("wanted")) for n in range(CAP)]
    rows = placed.groupBy("source").agg(
        *[F.max(F.when(c, F.col("key"))).alias(f"last{n}") for n, c in enumerate(inside)],
        F.sum(F.col("size") * sum((c.cast("long") for c in inside), F.lit(0))).alias("words")).collect()
    return {r["source"]: ([r[f"last{n}"] for n in range(CAP)], r["words"]) for r in rows}


def _share(key: int | None) -> float:
    return 0.0 if key is None else (key + (1 << 63)) / (1 << 64)


def drawn(docs: DataFrame, sized: DataFrame | None = None, shards: int = SHARDS, seed: int = SEED,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs -> (row, size, source_size, target, shards, orders): for every document the shards that its copies go to (none,
    one or two) and their sort keys inside those. A NULL text has size 0; NULL is a source of its own, the last; a source
    without words has target 0 and gives nothing. Repeated rows share a key and are drawn together.

    Only (source, size, key) is sorted and summed. It yields the last key that each source draws in each round, so the
    documents themselves are judged by their own key, without a join or a shuffle.
    """
    rows = _sized(docs) if sized is None else sized
    sizes = {r["source"]: r["words"] for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    want = dict(zip(order, targets([sizes[s] for s in order])))
    rows = _by_source(rows, [(s, sizes[s], want[s]) for s in order], "source_size long, target double")
    rows = rows.withColumn("small", (F.col("size") * LARGE <= F.col("source_size")).cast("int"))
    # One running sum over all lines, large documents before the small ones of a source; stored, since used three times.
    summed = cut_lineage(running_sums(rows.select("source", "small", "key", "size"),
                                      [F.col("source"), F.col("small"), F.col("key")], {"upto": "size"}))
    lines = {(r["source"], r["small"]): (r["words"], r["upto"] - r["words"]) for r in summed.groupBy("source", "small").agg(
        F.sum("size").alias("words"), F.max("upto").alias("upto")).collect()}
    line = lambda s, small: lines.get((s, small), (0, 0))
    large = _last_keys(summed, 0, {s: (*line(s, 0), want[s] * line(s, 0)[0] / max(1, sizes[s])) for s in order})
    none = ([None] * CAP, 0)
    rest = {s: want[s] - large.get(s, none)[1] for s in order}
    small = _last_keys(summed, 1, {s: (*line(s, 1), rest[s]) for s in order})
    block = max(block_words, math.ceil(sum(want.values()) / 1e8))
    quotas = [max(1, round(want[s] / block)) for s in order]
    per_shard = split(np.array(quotas), shards, seed) if order else np.zeros((shards, 0), np.int64)
    facts = []
    for i, s in enumerate(order):
        n = quotas[i]
        step = next(a for a in range(max(1, int(n * 0.618)), 2 * n + 2) if math.gcd(a, n) == 1)
        for is_small, keys in ((0, large.get(s, none)[0]), (1, small.get(s, none)[0])):
            extent = max([n_ + _share(k) for n_, k in enumerate(keys) if k is not None], default=0.0)
            facts.append((s, is_small, *keys, extent, n, step, [int(x) for x in np.cumsum(per_shard[:, i])]))
    limits = rows.sparkSession.createDataFrame(
        facts, "_source string, _small int, " + "".join(f"last{n} long, " for n in range(CAP))
        + "extent double, blocks long, step long, bounds array<long>")
    found = rows.join(limits, F.col("source").eqNullSafe(F.col("_source")) & (F.col("small") == F.col("_small")), "left")
    rounds = F.filter(F.array(*[F.when(F.col("key") <= F.col(f"last{n}"), F.lit(n)) for n in range(CAP)]), lambda n: n.isNotNull())
    share = F.col("key") / F.lit(2.0 ** 64) + 0.5
    number = lambda n: F.least(F.floor((n + share) / F.col("extent") * F.col("blocks")), F.col("blocks") - 1)
    permuted = lambda n: F.pmod(number(n) * F.col("step") + 7, F.col("blocks"))
    shard = lambda n: F.size(F.filter("bounds", lambda b: b <= permuted(n))).cast("int")
    return found.select("row", "size", "source_size", "target", F.transform(rounds, shard).alias("shards"),
                        F.transform(rounds, lambda n: F.xxhash64(F.lit(seed), F.col("key"), n)).alias("orders"))


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, shard, order): one row per copy drawn; sorting a shard by `order` shuffles it."""
    copies = F.explode(F.arrays_zip(F.col("shards").alias("shard"), F.col("orders").alias("order")))
    return drawn(docs, shards=shards).select("row", copies.alias("copy")).select("row", "copy.shard", "copy.order")


def mixture(docs: DataFrame) -> DataFrame:
    """The drawn copies with the documents' own columns, sorted inside the tasks by shard and order. Every shard is cut into
    at least `PIECES` pieces, and into more where the session is set to more shuffle partitions, so that no task's share is
    fixed by the number of shards."""
    pieces = max(PIECES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    return mixed(docs).repartition("shard", F.pmod("order", F.lit(pieces))).sortWithinPartitions("shard", "order").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    # The text ends at the scan: the sums and the result need its size and key only.
    found = drawn(docs, _sized(docs.select("doc_id", "source", "text")).withColumn("row", F.struct("row.doc_id")))
    return found.select("row.doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"),
                        "shards")
