"""Periodic runs: maximal stretches of consecutive words that repeat with a period, at least `REPEATS` times.

A run of period q with L <= q < 2L (L a power of two) holds whole aligned blocks of L words that stand again q words later. At
every scale L the words are cut into such blocks, and each block is compared with all L windows that begin L to 2L - 1 words
after it: sum (b - w)^2 = sum b^2 + sum w^2 - 2 sum b*w, where the last term is a convolution by an integer number-theoretic
transform. A sum of zero modulo the prime is necessary for a match, so none is missed; matched blocks are compared word for word
before they count. Consecutive matched blocks of one distance are a seed; since the blocks around it do not match, the run ends
less than a block away on either side, where it is extended word by word.

Scales go up, so shorter periods are known first. A seed inside a known run has a multiple of that run's period
(Fine and Wilf) and is not a run of its own; every other seed that reaches the length has its distance as smallest period.

Many texts are worked on at once: their words follow one another with a word of its own after each text, which nothing matches.
A text is never cut. Blocks are `BLOCK` words at most (longer periods take more windows per block), so memory grows with the words only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talus.llm.common import WORD_GAP, chunks, computed, row_column, small_batches

REPEATS = 4
LEAST_WORDS = 6
BLOCK = 1 << 17
# A prime of 7 * 2^20 + 1 and a generator of its units. Residues are held as doubles within half the prime of
# zero, so that sums of `_RADIX` products stay below 2^53 and are exact.
PRIME, GENERATOR = 7_340_033, 3
_RADIX = 64
_TILE = 1 << 15


def _centred(x: np.ndarray) -> np.ndarray:
    whole = x * (1 / PRIME)
    np.rint(whole, out=whole)
    whole *= PRIME
    x -= whole
    return x


@lru_cache(maxsize=64)
def _roots(order: int, rows: int, columns: int, sign: int) -> np.ndarray:
    """(rows, columns) powers w^(sign * i * j) of a root w of the given order."""
    root = pow(GENERATOR, (PRIME - 1) // order * (sign % order), PRIME)
    powers = np.ones(order, np.int64)
    have = 1
    while have < order:
        powers[have:2 * have] = powers[:have] * pow(root, have, PRIME) % PRIME
        have *= 2
    at = np.arange(rows)[:, None] * np.arange(columns) % order
    return _centred(powers[at].astype(float))


def transform(x: np.ndarray, sign: int) -> np.ndarray:
    """Number-theoretic transform of every row; the length is a power of two."""
    n = x.shape[1]
    if n <= _RADIX:
        return _centred(x @ _roots(n, n, n, sign))
    outer = min(_RADIX, 1 << ((n.bit_length()) // 2))
    inner = n // outer
    by_inner = np.ascontiguousarray(x.reshape(-1, outer, inner).transpose(0, 2, 1)).reshape(-1, outer)
    first = _centred(by_inner @ _roots(outer, outer, outer, sign)).reshape(-1, inner, outer)
    first = _centred(first * _roots(n, inner, outer, sign))
    second = transform(np.ascontiguousarray(first.transpose(0, 2, 1)).reshape(-1, inner), sign).reshape(-1, outer, inner)
    return np.ascontiguousarray(second.transpose(0, 2, 1)).reshape(-1, n)


def correlations(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """sum over i of blocks[r, i] * windows[r, i + s] modulo the prime, for s below the block length; the windows
    are twice as long as the blocks."""
    size = windows.shape[1]
    padded = np.zeros(windows.shape)
    padded[:, :blocks.shape[1]] = blocks
    product = _centred(transform(padded, -1) * transform(windows, 1))
    back = transform(product, -1)[:, :blocks.shape[1]]
    return _centred(back * float(pow(size, -1, PRIME)))


class _Known:
    """Runs found so far, for the question whether one of them covers an interval."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        order = np.argsort(starts, kind="stable")
        self.starts, ends, periods = starts[order], ends[order], periods[order]
        self.ends = np.maximum.accumulate(ends) if len(ends) else ends
        last = np.maximum.accumulate(np.where(ends == self.ends, np.arange(len(ends)), 0)) if len(ends) else order
        self.periods = periods[last]

    def cover(self, at: np.ndarray, length: np.ndarray, longest: int) -> np.ndarray:
        """Whether a run of a period up to `longest` covers [at, at + length). The run that reaches furthest among those
        that begin before is the only candidate: two runs cannot share so long a stretch."""
        if not len(self.starts):
            return np.zeros(len(at), bool)
        place = np.searchsorted(self.starts, at, side="right") - 1
        found = np.maximum(place, 0)
        return (place >= 0) & (self.ends[found] >= at + length) & (self.periods[found] <= longest)


def _seeds(codes: np.ndarray, n_blocks: int, block: int, scale: int, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """(distance, block number) of the blocks that stand again at a distance of scale to 2 * scale - 1."""
    values = _centred((codes % PRIME).astype(float))
    squares = np.concatenate([[0], np.cumsum((codes % PRIME) ** 2 % PRIME)])
    own = squares[block:] - squares[:-block]                       # of the block that begins at a place
    step = values.strides[0]
    distances, numbers = [], []
    tile = max(1, _TILE // (2 * block))
    for ahead in range(scale, 2 * scale, block):
        for j in range(0, n_blocks, tile):
            rows = min(tile, n_blocks - j)
            at = j * block
            blocks = np.lib.stride_tricks.as_strided(values[at:], (rows, block), (block * step, step))
            windows = np.lib.stride_tricks.as_strided(values[at + ahead:], (rows, 2 * block), (block * step, step))
            begins = at + np.arange(rows) * block
            both = own[begins][:, None] + own[begins[:, None] + ahead + np.arange(block)]
            rest = _centred(both.astype(float) - 2 * correlations(blocks, windows))
            row, shift = np.nonzero(rest == 0)
            q = shift + ahead
            # Where the block length reaches the period, a covered block is settled here.
            free = ~known.cover(begins[row], block + q, block)
            distances.append(q[free])
            numbers.append(row[free] + j)
    return np.concatenate(distances), np.concatenate(numbers)


def _chains(q: np.ndarray, number: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of at least `least` consecutive blocks of one distance: (distance, first block, blocks)."""
    order = np.lexsort((number, q))
    q, number = q[order], number[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (number[1:] != number[:-1] + 1)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(q)))
    kept = size >= least
    return q[begin[kept]], number[begin[kept]], size[kept]


def _reach(codes: np.ndarray, at: np.ndarray, q: np.ndarray, way: int, block: int) -> np.ndarray:
    """How many words on from `at` (or back from before it) equal the word q further; less than a block."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, (1 << 20) // block)
    for i in range(0, len(at), rows):
        places = at[i:i + rows, None] + way * np.arange(block) - (way < 0)
        there = np.maximum(places, 0)
        differs = (codes[there] != codes[there + q[i:i + rows, None]]) | (places < 0)
        out[i:i + rows] = np.where(differs.any(axis=1), differs.argmax(axis=1), block)
    return out


def _at_scale(codes: np.ndarray, words: int, scale: int, known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs with periods from scale to 2 * scale - 1 among the first `words` codes."""
    block = min(scale, BLOCK)
    n_blocks = -(-words // block)
    # The words past the end differ from all others.
    extra = n_blocks * block + 2 * scale + 2 * block - len(codes)
    codes = np.concatenate([codes, codes.max() + 1 + np.arange(max(0, extra))])
    least = (REPEATS - 1) * scale // block - 1
    q, first, size = _chains(*_seeds(codes, n_blocks, block, scale, known), least)
    if len(q):
        number = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        distance = np.repeat(q, size)
        alike = np.ones(len(number), bool)
        rows = max(1, (1 << 20) // block)
        for i in range(0, len(number), rows):
            places = number[i:i + rows, None] * block + np.arange(block)
            alike[i:i + rows] = (codes[places] == codes[places + distance[i:i + rows, None]]).all(axis=1)
        q, first, size = _chains(distance[alike], number[alike], least)
    free = ~known.cover(first * block, size * block + q, 2 * scale)
    q, begin, end = q[free], first[free] * block, (first[free] + size[free]) * block
    start = begin - _reach(codes, begin, q, -1, block)
    stop = end + _reach(codes, end, q, 1, block) + q
    kept = stop - start >= np.maximum(LEAST_WORDS, REPEATS * q)
    return start[kept], (stop - start)[kept], q[kept]


def runs(texts: list[list]) -> list[np.ndarray]:
    """Per text (a list of words) its runs as rows (start, length, period), by start, then period."""
    ids: dict = defaultdict(count().__next__)
    coded = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    found = [np.zeros((0, 4), np.int64)]                            # (text, start, length, period)
    scale = 1
    while True:
        members = np.flatnonzero(sizes >= max(LEAST_WORDS, REPEATS * scale))
        if not len(members):
            break
        parts = [p for i in members for p in (coded[i], np.array([len(ids) + i]))]
        codes = np.concatenate(parts)
        offsets = np.cumsum(sizes[members] + 1) - sizes[members] - 1
        place = np.full(len(texts), -1)
        place[members] = offsets
        before = np.concatenate(found)
        before = before[place[before[:, 0]] >= 0]
        begin = place[before[:, 0]] + before[:, 1]
        start, length, period = _at_scale(codes, len(codes), scale, _Known(begin, begin + before[:, 2], before[:, 3]))
        owner = np.searchsorted(offsets, start, side="right") - 1
        found.append(np.stack([members[owner], start - offsets[owner], length, period], axis=1))
        scale *= 2
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    cuts = np.searchsorted(every[:, 0], np.arange(len(texts) + 1))
    return [every[a:b, 1:] for a, b in zip(cuts, cuts[1:])]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period:start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept))


def scan(docs: DataFrame) -> DataFrame:
    """docs -> (row, n_words, runs, collapsed): `runs` is an array of (start, length, period) in words, by start, then period;
    `collapsed` the words outside the repeats, joined by one space, as bytes. A NULL or empty text has no words and no runs;
    repeated rows are worked out each on their own."""
    @pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [bytes(t) for t in batch]
            sizes, columns, rest = [], ([], [], []), []
            for a, b in chunks(texts):
                words = [t.split() for t in texts[a:b]]
                for own, found in zip(words, runs(words)):
                    sizes.append(len(own))
                    for column, values in zip(columns, found.T):
                        column.append(values)
                    rest.append(collapsed(own, found))
            yield pd.DataFrame({"n_words": np.array(sizes, np.int64), "starts": columns[0], "lengths": columns[1], "periods": columns[2],
                                "collapsed": pd.Series(rest, dtype=object)})

    found = small_batches(docs).select(row_column(docs)).withColumn(
        "found", find(F.coalesce(F.col("row.text").cast("binary"), F.lit(b""))))
    zipped = F.arrays_zip(F.col("found.starts").alias("start"), F.col("found.lengths").alias("length"), F.col("found.periods").alias("period"))
    return found.select("row", "found.n_words", zipped.alias("runs"), "found.collapsed")


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period; ties: the smallest start, then period. NULL without runs."""
    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (left > right) | ((left == right) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))))

    return F.aggregate(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)),
                       lambda best, r: F.when(better(best, r), best).otherwise(r))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's repeats: where crc32(doc_id) ends in 0, the words from place a on repeat the p words
    that begin there. Other texts, and those of NULL ids, are left as they are."""
    hash_ = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(hash_ % 10 == 0, F.lit(False)) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    rows = computed(docs.select("doc_id", "text"), words=F.when(chosen, words))
    n, g = F.size("words").cast("long"), F.floor(hash_ / 10)
    rows = computed(rows, a=F.when(chosen, g % n), p=F.when(chosen, 1 + F.floor((n - g % n) / (3 + g % 8))))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.when(chosen, F.array_join(F.transform("words", word), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, in the contract's form. A document without runs has four NULLs, the hash of no bytes as
    runs_sha256, and its words joined by one space as collapsed text."""
    found = computed(scan(planted(docs)), best=strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
