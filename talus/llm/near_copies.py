"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

Texts of equal lower-cased words are one node throughout (128 bits of their hash). Every node gets `BANDS` keys of `ROWS` least
shingle hashes each (min-hash), so two nodes of similarity j meet in some bucket with probability 1 - (1 - j^ROWS)^BANDS: 0.99997
at 0.8, more above. Only nodes that meet others get their shingle sets, in a second reading of their texts.

Buckets are settled in two steps. First every node is compared with one representative of each of its buckets, the node that
meets most others; that is a number of comparisons in proportion to the nodes, and it connects the copies of one text. Then only
buckets that still hold several components are compared whole, pairs of different components alone. Such a bucket of more than
`PART` nodes is cut into parts and every pair of parts is a piece of its own; a piece yields a forest of the links it found.
Buckets with the same members are compared once. Shingles are compared by 32 bits of their hash.

With `fingerprints`, texts whose SimHash fingerprints op8 links are near copies, too: the fingerprints come from the first reading,
and the links of both kinds are followed together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm import simhash
from talus.llm.common import WORD_GAP, ascii_lower, chunks, mix, row_column, small_batches, word_hashes
from talus.operators.cluster import connected_components
from talus.runtime import attach_to_groups, broadcast_if_small, cut_lineage

SHINGLE = 5
BANDS, ROWS = 20, 4
PART = 1024
SLOT_BYTES = 4 << 20
_FLIPS, _FACTORS = np.random.default_rng(58).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, and per text the number of its first (and the total). A text of fewer
    words than a shingle has one shingle of them all; one without words has one of its own."""
    words, _, _, _, firsts = word_hashes(texts)
    sizes = np.diff(firsts)
    counts = np.maximum(1, sizes - SHINGLE + 1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - firsts[:-1], counts)
    end = np.repeat(firsts[1:], counts)
    words = np.append(words, np.uint64(0))
    out = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < end, words[np.minimum(at + j, end)], np.uint64(0)))
    return out, starts


def bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; the number of the band is part of a key."""
    least = np.stack([np.minimum.reduceat((hashes ^ a) * b, starts[:-1]) for a, b in zip(_FLIPS, _FACTORS)], axis=1)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + least[:, r::ROWS])
    return keys.view(np.int64)


def linked(sets: list[np.ndarray], groups: list | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """A forest that connects what pairs of similar sets connect beyond their groups; with `split`, pairs across that place
    only. Two sets cannot be similar if one is too small for the other, or has too many members that no other set here has;
    sets with few such members come first, since they connect most others at once."""
    n = len(sets)
    label = np.arange(n) if groups is None else np.unique(np.array(groups, dtype=object), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.add.reduceat((times[flat] > 1).astype(np.int64), starts[:-1])   # members that others have, too
    side = np.zeros(n, int) if split is None else (np.arange(n) >= split).astype(int)
    fresh = np.ones(n, bool)
    marked = np.zeros(len(times), bool)
    edges = []
    for i in np.argsort((sizes - shared) / sizes, kind="stable"):
        if (label == label[0]).all():
            break
        fresh[i] = False
        # 9 * both >= 4 * (a + b) is a similarity of 0.8; both cannot exceed what either shares with others.
        most = np.minimum(shared[i], shared)
        rest = np.flatnonzero(fresh & (label != label[i]) & (9 * most >= 4 * (sizes[i] + sizes)) & ((split is None) | (side != side[i])))
        if not len(rest):
            continue
        marked[flat[starts[i]:starts[i + 1]]] = True
        lengths = sizes[rest]
        begin = np.cumsum(lengths) - lengths
        places = np.arange(lengths.sum()) + np.repeat(starts[rest] - begin, lengths)
        both = np.add.reduceat(marked[flat[places]], begin, dtype=np.int64)
        marked[flat[starts[i]:starts[i + 1]]] = False
        for j in rest[9 * both >= 4 * (sizes[i] + lengths)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((int(i), int(j)))
    return edges


def node(text: Column) -> Column:
    """The same for texts of the same lower-cased words; a NULL text is an empty one."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_GAP, " "))
    return F.unhex(F.md5(words.cast("binary")))


def _row_key() -> Column:
    """The same for rows of the same id and text only, but for chance; repeated rows share it."""
    return F.xxhash64("doc_id", "text")


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [bytes(t) for t in batch["text"]]
        for a, b in chunks(texts):
            keys = bands(*shingles(texts[a:b]))
            yield pd.DataFrame({"row_key": batch["row_key"].iloc[a:b].array, "node": batch["node"].iloc[a:b].array,
                                "id": batch["id"].iloc[a:b].array, "keys": list(keys)})


def _marks_and_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = np.array([simhash.fingerprint(bytes(t)) for t in batch["text"]], np.uint64).view(np.int64)
        done = 0
        for marks in _marks(iter([batch])):
            yield marks.assign(print=prints[done:done + len(marks)])
            done += len(marks)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [bytes(t) for t in batch["text"]]
        for a, b in chunks(texts):
            hashes, starts = shingles(texts[a:b])
            short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pd.DataFrame({"node": batch["node"].iloc[a:b].array, "shingles": [np.unique(short[s:e]) for s, e in zip(starts, starts[1:])]})


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (_, p, q), piece in rows.sort_values("part").groupby(["key", "p", "q"]):
        nodes = piece["node"].to_numpy()
        split = None if p == q else int((piece["part"] == p).sum())
        if len(nodes) > 1 and split not in (0, len(nodes)):
            found = linked([np.asarray(s) for s in piece["shingles"]], [bytes(c) for c in piece["class"]], split)
            out += [(nodes[i], nodes[j]) for i, j in found]
    return pd.DataFrame(out, columns=["a", "b"], dtype=object)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes those of similarity 0.8 at least."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def star_links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, key, members) -> edges between nodes and the representatives of their buckets, where they are similar."""
    support = met.groupBy("node").agg(F.sum("members").alias("support"))
    leads = met.join(support, "node").groupBy("key").agg(F.max(F.struct("support", "node")).alias("lead"))
    pairs = met.join(leads, "key").select(F.col("lead.node").alias("a"), F.col("node").alias("b")).where("a != b").distinct()
    return similar(pairs, sets)


def rest_links(met: DataFrame, sets: DataFrame, reached: DataFrame, part: int = PART) -> DataFrame:
    """(node, key, members) -> edges between nodes of different components (`reached`: node, class) that share a bucket."""
    placed = met.where("members > 2").join(reached, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mark = [F.sum(F.xxhash64(F.lit(salt), "node").cast("decimal(38,0)")).alias(f"mark{salt}") for salt in (1, 2)]
    mixed = placed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n"), *mark).where(
        "least != most").groupBy("n", "mark1", "mark2").agg(F.min("key").alias("key"))
    open_ = cut_lineage(placed.join(mixed.select("key"), "key"))
    held = open_.join(sets.select("node", F.size("shingles").alias("size")), "node").agg(F.sum("size")).first()[0] or 0
    if not held:
        return open_.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    slots = max(1, math.ceil(4 * held / SLOT_BYTES))
    parts = F.ceil(F.col("members") / part).cast("int")
    cut = open_.select("node", "class", "key", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    pieces = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "node", "class", "key", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    whole = pieces.join(sets, "node").withColumn("slot", F.pmod(F.xxhash64("key", "p", "q"), F.lit(slots)).cast("int"))
    return whole.groupBy("slot").applyInPandas(_linked, "a binary, b binary").distinct()


def print_links(nodes: DataFrame) -> DataFrame:
    """nodes (node, print) -> edges between every node and the smallest one of those that linked fingerprints connect."""
    reached = simhash.reached(cut_lineage(nodes.select("print").distinct()))
    placed = nodes.join(reached, "print", "left").select("node", F.coalesce("class", "print").alias("class"))
    first = placed.groupBy("class").agg(F.min("node").alias("a"))
    return attach_to_groups(placed, first, ["class"]).where("a != node").select("a", F.col("node").alias("b"))


def _components(edges: DataFrame) -> DataFrame:
    touched = edges.select("a").union(edges.select("b")).distinct().toDF("node")
    return connected_components(touched, edges).toDF("node", "class")


def classes(docs: DataFrame, part: int = PART, fingerprints: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (row_key, node, id, class) for every row: `class` is one node of the group that near copies
    connect, with `fingerprints` those of linked SimHash fingerprints included."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    binary = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    rows = small_batches(docs).select(_row_key().alias("row_key"), F.col("doc_id").alias("id"), node(F.col("text")).alias("node"), binary)
    marked, made = (_marks_and_prints, ", print long") if fingerprints else (_marks, "")
    marks = cut_lineage(rows.mapInPandas(marked, f"row_key long, node binary, id {id_type}, keys array<long>{made}"))
    nodes = marks.groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", "row_key", F.explode("keys").alias("key"))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    met = cut_lineage(keyed.join(crowds, "key"))
    wanted = met.select("node", "row_key").distinct()
    texts = docs.select(_row_key().alias("row_key"), binary).join(broadcast_if_small(wanted), "row_key")
    sets = cut_lineage(texts.mapInPandas(_sets, "node binary, shingles array<int>").groupBy("node").agg(
        F.first("shingles").alias("shingles")))
    met = met.drop("row_key")
    edges = star_links(met, sets)
    if fingerprints:
        edges = edges.union(print_links(cut_lineage(marks.groupBy("node").agg(F.first("print").alias("print")))))
    edges = cut_lineage(edges)
    reached = _components(edges)
    more = cut_lineage(rest_links(met, sets, reached, part))
    if not more.isEmpty():
        reached = _components(edges.union(more))
    return marks.drop("keys", "print").join(reached, "node", "left").withColumn("class", F.coalesce("class", "node"))


def keep_one(docs: DataFrame, part: int = PART, fingerprints: bool = False) -> DataFrame:
    """One document of every group that near copies connect, that with the smallest doc_id, with its own columns; NULL ids
    only where a group has no other. Of repeated rows one stays. The texts are not shuffled while the rows that go are few
    enough to be broadcast."""
    placed = cut_lineage(classes(docs.select("doc_id", "text"), part, fingerprints).groupBy("class", "row_key").agg(
        F.min("id").alias("id"), F.count("*").alias("times")))
    least = F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("least")
    kept = placed.groupBy("class").agg(least).select("class", F.col("least.row_key").alias("kept"))
    judged = cut_lineage(attach_to_groups(placed, kept, ["class"]).select("row_key", (F.col("row_key") == F.col("kept")).alias("stays"), "times"))
    rows = docs.select(row_column(docs), _row_key().alias("row_key"))
    gone = judged.where(~F.col("stays")).select("row_key")
    left = rows.join(broadcast_if_small(gone), "row_key", "left_anti")
    repeated = judged.where(F.col("stays") & (F.col("times") > 1)).select("row_key")
    if repeated.isEmpty():
        return left.select("row.*")
    listed = broadcast_if_small(repeated)
    one = Window.partitionBy("row_key").orderBy(F.xxhash64("row"))
    again = left.join(listed, "row_key", "left_semi").withColumn("place", F.row_number().over(one)).where(F.col("place") == 1)
    return left.join(listed, "row_key", "left_anti").select("row.*").union(again.select("row.*"))
