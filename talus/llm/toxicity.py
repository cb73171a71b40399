"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits and their prefixes of four and five bytes, hashed into a fixed number of
buckets; a text holds a bucket with the value 1 + ln(occurrences). Buckets that differ between the classes (chi-square over the sample) get a linear
weight and a factor; the score is the logistic of bias + sum of weights + sum over pairs of the factors' products, so a
pair of terms can mean more than both on their own. Labels are learnt from a bounded sample of each class
(`SAMPLE_PER_CLASS` ids in expectation, by hash of the id, and twice as many rows at most); the `MOST_TERMS` buckets that differ most
are used; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talus.llm.common import (
    _BASE, _BYTE_VALUE, _UNBASE, _powers, capped, chunks, is_fold, learnable, mix, row_column, small_batches, word_hashes,
)

SAMPLE_PER_CLASS = 3000
BUCKET_BITS = 18
PREFIXES = (4, 5)
FACTORS = 4
CHI_SQUARE = 25.0
MOST_TERMS = 4096
THRESHOLD = 0.3
_NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FOLDS, HELD = 4, 2


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every term occurrence of the texts."""
    hashes, starts, ends, low, firsts = word_hashes(texts, _NO_TERM)
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    found = [(owner, hashes)]
    sums = np.cumsum(_BYTE_VALUE[low] * _powers(_BASE, len(low)), dtype=np.uint64)
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        at = starts[long]
        ahead = np.where(at > 0, sums[at - 1], np.uint64(0))
        found.append((owner[long], mix((sums[at + n - 1] - ahead) * _powers(_UNBASE, len(low))[at] + np.uint64(n))))
    return (np.concatenate([o for o, _ in found]),
            (np.concatenate([h for _, h in found]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))


def value(times: np.ndarray) -> np.ndarray:
    return 1 + np.log(times)


@dataclass
class Model:
    slots: np.ndarray    # bucket -> number of its weight, -1 for none
    bias: float
    weights: np.ndarray  # (slots,)
    factors: np.ndarray  # (slots, FACTORS)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in chunks(texts):
            owner, bucket = terms(texts[a:b])
            slot = self.slots[bucket]
            known = slot >= 0
            pairs, times = np.unique(owner[known] * len(self.weights) + slot[known], return_counts=True)
            doc, slot = np.divmod(pairs, max(1, len(self.weights)))
            out[a:b] = self._logistic(doc, slot, value(times), b - a)
        return out

    def _logistic(self, doc: np.ndarray, slot: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + np.bincount(doc, self.weights[slot] * x, n)
        for k in range(self.factors.shape[1]):
            v = self.factors[slot, k] * x
            total += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, steps: int = 250, rate: float = 0.05,
        decay: float = 3e-4) -> Model:
    """Full-batch Adam on the logistic loss. `samples`: every text's distinct buckets and their counts; `weight`: rows of the whole
    table that a sampled row stands for. With one class only, the score is constant."""
    labels = np.asarray(labels, float)
    none = np.full(1 << BUCKET_BITS, -1, np.int32)
    if not len(labels) or labels.min() == labels.max():
        return Model(none, 40.0 if len(labels) and labels[0] else -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    doc = np.repeat(np.arange(len(samples)), [len(s) for s, _ in samples])
    bucket = np.concatenate([s for s, _ in samples]).astype(np.int64)
    times = np.concatenate([t for _, t in samples])
    n, n1 = len(labels), labels.sum()
    with_term = np.bincount(bucket, minlength=1 << BUCKET_BITS).astype(float)
    both = np.bincount(bucket, labels[doc], 1 << BUCKET_BITS)
    other = (with_term * (n - with_term) * n1 * (n - n1)).clip(1)
    differs = n * (both * n - with_term * n1) ** 2 / other
    chosen = np.sort(np.argsort(-differs, kind="stable")[:MOST_TERMS])
    chosen = chosen[differs[chosen] >= CHI_SQUARE]
    none[chosen] = np.arange(len(chosen))
    kept = none[bucket] >= 0
    x = np.zeros((n, len(chosen)), np.float32)
    x[doc[kept], none[bucket[kept]]] = value(times[kept])
    weight = np.asarray(weight, float)
    weight = np.minimum(weight / weight.min(), 10)
    weight = weight / weight.sum()
    squares = x * x
    random = np.random.default_rng(7)
    state = [np.zeros(1), np.zeros(len(chosen)), random.normal(0, 0.05, (len(chosen), FACTORS))]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for step in range(1, steps + 1):
        # The matrix stays in single precision; the weights and their averages are kept in double.
        bias, w, v = (s.astype(np.float32) for s in state)
        inner = x @ v
        total = bias + x @ w + 0.5 * (inner ** 2 - squares @ (v * v)).sum(1)
        slope = ((1 / (1 + np.exp(-np.clip(total, -40, 40))) - labels) * weight).astype(np.float32)
        per_term = x.T @ slope
        grads = [slope.sum(keepdims=True), per_term + decay * w,
                 x.T @ (slope[:, None] * inner) - (squares.T @ slope)[:, None] * v + decay * v]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            state[i] = state[i] - rate * (first[i] / (1 - 0.9 ** step)) / (
                np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Model(none, float(state[0][0]), state[1], state[2])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold. A document labelled more than once
    counts as toxic if any of its labels says so; NULL labels teach nothing."""
    known = (
        labels.where(F.col("toxic").isNotNull() & learnable(F.col("doc_id"), FOLDS, HELD))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_class / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000)) < share * 1_000_000
    # About 2 * per_class ids whatever the size of the table.
    sample = F.broadcast(known.where(drawn))
    texts = capped(small_batches(docs).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(sample, "doc_id"),
                   "label", 2 * per_class)

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [np.unique(terms([bytes(t)])[1], return_counts=True) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "terms": [b.astype(np.int32).tobytes() for b, _ in held],
                                "times": [n.astype(np.int32).tobytes() for _, n in held]})

    rows = sorted(texts.mapInPandas(buckets, "label int, terms binary, times binary").collect())
    return fit([(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["times"], np.int32)) for r in rows], np.array([r["label"] for r in rows]),
               np.array([max(1.0, counts[r["label"]] / per_class) for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> (row, score, predicted): `row` holds all columns of the document. NULL and empty texts get the score of
    a text without any known term; every row, repeated ones too, is scored on its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.score([bytes(t) for t in batch]))

    text = F.coalesce(F.col("row.text").cast("binary"), F.lit(b""))
    return (
        small_batches(docs).select(row_column(docs)).withColumn("score", judge(text))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("row.doc_id", is_fold(F.col("row.doc_id"), FOLDS, HELD).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    return score(docs, train(docs, labels)).where(F.col("predicted") == 0).select("row.*")
