"""What several operators share: input tables, folds, and the hashing of words in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.functions.text import once

# Words are runs of bytes other than space and 0x09-0x0D; bytes.split() cuts exactly there.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_ROWS = 1000
_U64 = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame, its session set to hand Python at most `BATCH_ROWS` rows at once: texts are long, and a worker holds a batch
    several times over."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def row_column(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def computed(df: DataFrame, **made: Column) -> DataFrame:
    """Add columns that are worked out once a row, however often later expressions use them."""
    return df.select("*", once(**made))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; NULL for a NULL id, which is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def is_fold(doc_id: Column, parts: int, held: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == held, F.lit(False))


def learnable(doc_id: Column, parts: int, held: int) -> Column:
    """Rows a model may learn from: those with an id outside the held-out fold."""
    return F.coalesce(fold(doc_id, parts) != held, F.lit(False))


def capped(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` rows of every label, those with the least hash of (doc_id, text): however often one row is repeated, no
    more of them are drawn. Every task keeps that many before the shuffle."""
    first = Window.partitionBy(label).orderBy("_draw")
    numbered = rows.withColumn("_draw", F.xxhash64("doc_id", "text")).withColumn("_place", F.row_number().over(first))
    return numbered.where(F.col("_place") <= most).drop("_draw", "_place")


def word_count(text: Column) -> Column:
    """Number of words, 0 for NULL: a word begins where a word byte follows a gap or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `limit` bytes each, so that arrays per byte stay small."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_GAP_BYTE = np.zeros(256, bool)
_GAP_BYTE[[32, 9, 10, 11, 12, 13]] = True
# One random 64-bit value per lower-cased byte; a word's hash is a polynomial in them, then mixed.
_BYTE_VALUE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U64)[_LOWER_BYTE]
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 bits."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(33))


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006 - grows once per worker
    if len(kept.get(base, ())) < n:
        p = np.full(max(n, 1_100_000), base, _U64)    # a chunk of texts and a little more
        p[0] = 1
        kept[base] = np.multiply.accumulate(p)
    return kept[base][:n]


def word_hashes(texts: list[bytes], gap_bytes: np.ndarray = _GAP_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of the texts, in order: (64-bit hash, first byte, byte after the last) per word, the buffer
    of lower-cased bytes that the places refer to, and per text the number of its first word (one entry more, the total).

    Words are runs of bytes that `gap_bytes` does not mark, by default the contracts' white space. Prefix sums give every word's polynomial hash without a loop over words.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = gap_bytes[raw]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    sums = np.cumsum(_BYTE_VALUE[raw] * _powers(_BASE, len(raw)), dtype=_U64)
    ahead = np.where(starts > 0, sums[starts - 1], _U64(0))
    hashes = mix((sums[ends - 1] - ahead) * _powers(_UNBASE, len(raw))[starts])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, starts, ends, _LOWER_BYTE[raw], firsts


def per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of `values` (one per word, or rows of them) over the words of every text; 0 for a text without words."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[firsts[1:]] - total[firsts[:-1]]
