"""Language identification: a byte convolutional network.

A text's lower-cased bytes are cut into windows of `WINDOW` bytes. Every byte gets a small embedding; filters of several
widths run over the window, each filter keeps its maximum, and a softmax layer turns the maxima into language
probabilities. The text's language is the one with the largest mean log-probability over all its windows. Trained in
numpy on a bounded sample of labelled rows (`SAMPLE_PER_LANGUAGE` texts per language in expectation, fewer where there are more than
`SAMPLE_TEXTS` in all, and twice as many at most; `SAMPLE_WINDOWS` windows of each, spread over the whole text). The languages are the
labels found in the data, the `MOST_LANGUAGES` commonest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talus.llm.common import _LOWER_BYTE, capped, chunks, is_fold, learnable, row_column, small_batches

SAMPLE_PER_LANGUAGE = 600
SAMPLE_TEXTS = 6000
MOST_LANGUAGES = 100
SAMPLE_WINDOWS = 4
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12          # per width
EMBEDDING = 4
FOLDS, HELD = 3, 1
UNKNOWN = "und"
REJECT = 1.5          # least evidence (natural log odds of `und`, summed over the windows) at which a text is rejected
_TILE = 256           # windows computed at once
_SPAN = max(WIDTHS)
# Alphabets of what is no language: random letters, codes, encoded bytes, digits and marks.
_LOW, _DIGITS = np.arange(97, 123), np.arange(48, 58)
_CODES = [np.append(_LOW, [32] * 5), np.concatenate([_LOW, _DIGITS]), np.concatenate([_DIGITS, _LOW[:6]]),
          np.concatenate([_LOW, _LOW, _DIGITS, [43, 47, 61]]), np.concatenate([_DIGITS, [32, 32, 46, 44, 58, 45]]),
          np.concatenate([np.setdiff1d(_LOW, [97, 101, 105, 111, 117]), [32] * 4]), np.arange(33, 65),
          np.concatenate([np.arange(33, 48), np.arange(58, 65), np.arange(91, 97), np.arange(123, 127), [32] * 6]), np.arange(32, 127), np.arange(1, 256)]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(window, WINDOW) bytes, zero-padded, and the number of windows of every text (one at least)."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = 0
    for text, n in zip(texts, counts):
        flat[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * WINDOW
    return _LOWER_BYTE[flat].reshape(-1, WINDOW), counts


@dataclass
class Model:
    languages: list[str]
    bytes_: np.ndarray    # (256, EMBEDDING); the padding byte is zero
    filters: np.ndarray   # (_SPAN * EMBEDDING, filters); rows past a filter's width are zero
    offset: np.ndarray
    top: np.ndarray       # (filters, languages)
    base: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of all filters over the windows, where they are, and the stacked embeddings they were taken from."""
        held = self.bytes_[x]
        steps = x.shape[1] - _SPAN + 1
        stacked = np.concatenate([held[:, j:j + steps] for j in range(_SPAN)], axis=2)
        out = (stacked.reshape(-1, stacked.shape[2]) @ self.filters).reshape(len(x), steps, -1)
        return out, stacked, steps

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(x), _TILE):
            out, _, _ = self.pooled(x[i:i + _TILE])
            logits = np.maximum(out.max(axis=1) + self.offset, 0) @ self.top + self.base
            logits -= logits.max(axis=1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(parts)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: language, score, and the evidence that it is none: log odds of `und` summed over the windows (0 for a
        model that did not learn that label)."""
        names, sure, odds = [], np.empty(len(texts)), np.zeros(len(texts))
        none = self.languages.index(UNKNOWN) if UNKNOWN in self.languages else None
        for a, b in chunks(texts):
            x, counts = windows(texts[a:b])
            begins = np.cumsum(counts) - counts
            logs = self.log_probabilities(x)
            mean = np.add.reduceat(logs, begins, axis=0) / counts[:, None]
            mean = np.exp(mean - mean.max(axis=1, keepdims=True))
            mean /= mean.sum(axis=1, keepdims=True)
            best = mean.argmax(axis=1)
            names += [self.languages[i] for i in best]
            sure[a:b] = mean[np.arange(len(best)), best]
            if none is not None:
                p = np.clip(np.exp(logs[:, none].astype(float)), 1e-9, 1 - 1e-9)
                odds[a:b] = np.add.reduceat(np.log(p) - np.log1p(-p), begins)
        return names, np.clip(sure, 0, 1), odds


def fit(x: np.ndarray, labels: list[str], epochs: int = 14, batch: int = 64, rate: float = 0.01) -> Model | None:
    """Adam on the cross-entropy of single windows; None without labelled windows."""
    if not len(x):
        return None
    languages = sorted(set(labels))
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in labels])
    random = np.random.default_rng(11)
    n_filters = FILTERS * len(WIDTHS)
    width = np.repeat(WIDTHS, FILTERS)
    mask = (np.arange(_SPAN)[:, None] < width[None, :]).repeat(EMBEDDING, axis=0).astype(np.float32)
    model = Model(languages, random.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
                  (random.normal(0, 0.4, (_SPAN * EMBEDDING, n_filters)) * mask).astype(np.float32),
                  np.zeros(n_filters, np.float32), random.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    model.bytes_[0] = 0
    names = ("bytes_", "filters", "offset", "top", "base")
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    # Every language weighs the same, however many windows it has.
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for i in range(0, len(order), batch):
            step += 1
            pick = order[i:i + batch]
            xb, yb, wb = x[pick], y[pick], weight[pick]
            out, stacked, _ = model.pooled(xb)
            at = out.argmax(axis=1)                                   # (n, filters)
            rows = np.arange(len(pick))
            hidden = np.maximum(np.take_along_axis(out, at[:, None, :], 1)[:, 0] + model.offset, 0)
            logits = hidden @ model.top + model.base
            soft = np.exp(logits - logits.max(axis=1, keepdims=True))
            soft /= soft.sum(axis=1, keepdims=True)
            soft[rows, yb] -= 1
            soft *= wb[:, None] / len(pick)
            back = (soft @ model.top.T) * (hidden > 0)                # (n, filters)
            seen = stacked[rows[:, None], at]                         # (n, filters, span * embedding)
            grads = {"top": hidden.T @ soft, "base": soft.sum(0), "offset": back.sum(0),
                     "filters": np.einsum("nf,nfe->ef", back, seen) * mask}
            to_bytes = (back[:, :, None] * model.filters.T[None]).reshape(len(pick), n_filters, _SPAN, EMBEDDING)
            source = xb[rows[:, None, None], at[:, :, None] + np.arange(_SPAN)]
            grads["bytes_"] = np.stack([np.bincount(source.ravel(), to_bytes[..., e].ravel(), 256)
                                        for e in range(EMBEDDING)], axis=1).astype(np.float32)
            grads["bytes_"][0] = 0
            pace = rate * (1 - epoch / epochs)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                setattr(model, k, (getattr(model, k) - pace * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32))
    return model


def junk(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """As many windows of what is no language as there are windows of text, each of the length of one: its own letters
    replaced, few characters repeated, or characters drawn from `_CODES`."""
    random = np.random.default_rng(seed)
    low = np.arange(97, 123)
    out = np.zeros_like(x)
    for i, window in enumerate(x):
        n = max(1, int(np.count_nonzero(window)))
        kind = i % (len(_CODES) + 2)
        if kind == 0:
            letter = (window[:n] >= 97) & (window[:n] <= 122)
            out[i, :n] = np.where(letter, random.choice(low, n), window[:n])
        elif kind == 1:
            out[i, :n] = np.resize(random.choice(np.arange(33, 127), random.integers(1, 5)), n)
        else:
            out[i, :n] = random.choice(_CODES[kind - 2], n)
    return _LOWER_BYTE[out]


def with_codes(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """The windows, in half of them a stretch of up to three quarters overwritten by a code: text that holds a number, a key or
    an address is still text."""
    random = np.random.default_rng(seed)
    out = x.copy()
    for i in np.flatnonzero(random.random(len(x)) < 0.5):
        n = int(np.count_nonzero(x[i]))
        size = int(n * 0.75 * random.random())
        at = random.integers(0, n - size + 1)
        out[i, at:at + size] = random.choice(_CODES[random.integers(len(_CODES))], size)
    return _LOWER_BYTE[out]


def shortened(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """The windows, two thirds of them cut to a length drawn from all lengths, evenly by its logarithm."""
    random = np.random.default_rng(seed)
    length = np.where(random.random(len(x)) < 2 / 3, np.exp(random.uniform(0, np.log(WINDOW + 1), len(x))), WINDOW).astype(int)
    return np.where(np.arange(WINDOW)[None, :] < np.maximum(1, length)[:, None], x, 0).astype(np.uint8)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, reject: bool = False) -> Model | None:
    """Fit on a bounded sample per language of the labelled rows outside the held-out fold. With `reject` the network
    learns what is no language, too, as one label more, `und`, and windows of all lengths."""
    known = small_batches(docs).select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id"), FOLDS, HELD) & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    per_language = max(1, min(per_language, SAMPLE_TEXTS // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in counts], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000)) < F.col("share") * 1_000_000
    rows = known.join(F.broadcast(shares), "lang").where(drawn)  # one row per language, `MOST_LANGUAGES` at most
    sample = capped(rows, "lang", 2 * per_language).select("lang", F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, held = [], []
            for lang, text in zip(batch["lang"], batch["text"]):
                x, _ = windows([bytes(text)])
                places = np.unique(np.linspace(0, len(x) - 1, SAMPLE_WINDOWS).astype(int))
                langs += [lang] * len(places)
                held += [x[i].tobytes() for i in places]
            yield pd.DataFrame({"lang": langs, "held": held})

    rows = sorted(sample.mapInPandas(cut, "lang string, held binary").collect())
    if not rows:
        return None
    x, labels = np.frombuffer(b"".join(bytes(r["held"]) for r in rows), np.uint8).reshape(-1, WINDOW), [r["lang"] for r in rows]
    if reject:
        x = shortened(x)
        x, made = with_codes(x), junk(x)
        x, labels = np.concatenate([x, made]), labels + [UNKNOWN] * len(made)
    return fit(x, labels)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs -> (row, lang_pred, score, no_language). `und` with score 0 for a NULL text, one without a letter, or when there was
    nothing to learn from; with a score of its own where the model has that label. `no_language` is the summed evidence against
    any language, infinite without a letter. Every row is predicted from its text alone, repeated rows each on their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double, no_language double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, sure, odds = shared.value.predict([bytes(t) for t in batch])
            yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": sure, "no_language": odds})

    text = F.col("row.text")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = small_batches(docs).select(row_column(docs))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.when(lettered, 0.0).otherwise(float("inf")).alias("no_language"))
    guessed = rows.withColumn("guess", guess(F.coalesce(text.cast("binary"), F.lit(b""))))
    return guessed.select("row", F.when(lettered, F.col("guess.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                          F.when(lettered, F.col("guess.score")).otherwise(0.0).alias("score"),
                          F.when(lettered, F.col("guess.no_language")).otherwise(float("inf")).alias("no_language"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; `und` and 0 for NULL and letterless texts."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("row.doc_id", is_fold(F.col("row.doc_id"), FOLDS, HELD).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in a language that was learnt, with their own columns. Rejected are NULL texts, those without a
    letter, and those whose windows together weigh `REJECT` or more for no language; the network learns windows of no
    language as well, of all lengths. A short text holds little evidence either way, a long one is judged by all of its
    windows. With no labelled row to learn from, only NULL and letterless texts are rejected."""
    found = predict(docs, train(docs, reject=True))
    return found.where(F.col("no_language") < REJECT).select("row.*")
