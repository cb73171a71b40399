"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a text are Spark columns. On a bounded sample of labelled rows (`SAMPLE_PER_CLASS` of each class in expectation,
twice as many at most) small regression trees are boosted on the logistic loss; every path from a root to a node is a rule, a conjunction
of comparisons of statistics with thresholds. A logistic model with an L1 penalty weighs the rules and drops most of them; the
penalty is the largest whose loss on a fifth of the sample, left out of the fit, is near the least. The rules that keep a weight become Spark
columns, so that all texts are scored without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import WORD_GAP, capped, computed, is_fold, learnable, row_column

SAMPLE_PER_CLASS = 3000
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
TREES, DEPTH, RATE = 40, 3, 0.3
CUTS = 24                 # candidate thresholds per statistic
LEAST_SHARE = 0.004       # of the sample that a rule must hold for, and not hold for
PENALTIES = tuple(0.03 * 0.6 ** k for k in range(10))
NEAR = 1.02
NO_WEIGHT = 1e-3
CLASS_WEIGHT = 10.0       # most that a row of the commoner class counts more than one of the other
SYMBOLS = "#*$%&|<>"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
STATISTICS = ("words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "exclaim_share", "different_words",
              "stutter_share", "repeated_lines", "words_per_line")


def described(docs: DataFrame) -> DataFrame:
    """docs -> (row, one column per statistic). Shares are 0 where there is nothing to take a share of; a NULL text is empty."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = computed(docs.select(row_column(docs)), words=F.filter(F.split(text, WORD_GAP), lambda w: w != ""))
    of = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
    chars = F.length(text)
    held = lambda which: chars - F.length(F.translate(text, which, ""))
    n = F.size("words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stutter = F.size(F.filter("words", lambda w, i: F.coalesce(F.get("words", i - 1) == w, F.lit(False))))
    rows = computed(rows, n=n, chars=chars, solid=chars - held(" \t\n\x0b\x0c\r"), line_count=F.size(lines),
                    line_kinds=F.size(F.array_distinct(lines)), kinds=F.size(F.array_distinct("words")), stutters=stutter)
    made = {
        "words": F.col("n").cast("double"), "word_length": of(F.col("solid"), F.col("n")),
        "symbol_share": of(held(SYMBOLS), F.col("solid")), "upper_share": of(held(ALPHABET.upper()), F.col("solid")),
        "digit_share": of(held("0123456789"), F.col("solid")), "mark_share": of(held(".,;:?'\"()-"), F.col("solid")),
        "exclaim_share": of(held("!"), F.col("solid")), "different_words": of(F.col("kinds"), F.col("n")),
        "stutter_share": of(F.col("stutters"), F.col("n")),
        "repeated_lines": of(F.col("line_count") - F.col("line_kinds"), F.col("line_count")),
        "words_per_line": of(F.col("n"), F.col("line_count")),
    }
    return computed(rows.drop("words"), **made).select("row", *STATISTICS)


Condition = tuple[int, bool, float]      # statistic, whether at most (else above), threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, at_most, cut in self.conditions:
            out &= (x[:, k] <= cut) if at_most else (x[:, k] > cut)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, at_most, cut in self.conditions:
            c = F.col(STATISTICS[k])
            out = out & ((c <= F.lit(cut)) if at_most else (c > F.lit(cut)))
        return out

    def __str__(self) -> str:
        parts = [f"{STATISTICS[k]} {'<=' if at_most else '>'} {cut:.6g}" for k, at_most, cut in self.conditions]
        return f"{self.weight:+.3f} if {' and '.join(parts)}"


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))


def _tighter(conditions: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One condition per statistic and direction."""
    out: dict = {}
    for k, at_most, cut in conditions:
        old = out.get((k, at_most), cut)
        out[k, at_most] = min(old, cut) if at_most else max(old, cut)
    return tuple((k, at_most, cut) for (k, at_most), cut in sorted(out.items()))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int,
          path: tuple, paths: set, step: np.ndarray) -> None:
    """One node of a regression tree: `step` receives the leaves' values, `paths` the conditions that lead to every node."""
    if path:
        paths.add(_tighter(path))
    best = (1e-9, None, None)
    g, h = gradient[rows], hessian[rows]
    base = g.sum() ** 2 / (h.sum() + 1)
    if depth:
        for k, edges in enumerate(cuts):
            if not len(edges):
                continue
            left_g = np.cumsum(np.bincount(bins[rows, k], g, len(edges) + 1))[:-1]
            left_h = np.cumsum(np.bincount(bins[rows, k], h, len(edges) + 1))[:-1]
            gain = left_g ** 2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - base
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
    _, k, at = best
    if k is None:
        step[rows] = -g.sum() / (h.sum() + 1)
        return
    low = bins[rows, k] <= at
    for part, at_most in ((rows[low], True), (rows[~low], False)):
        if len(part):
            _grow(bins, cuts, gradient, hessian, part, depth - 1, (*path, (k, at_most, float(cuts[k][at]))), paths, step)


def extracted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """Rules: the paths of boosted trees over the statistics."""
    cuts = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2), method="lower"))
        cuts.append((values[:-1] + values[1:]) / 2)
    bins = np.stack([np.searchsorted(edges, column, side="left") for edges, column in zip(cuts, x.T)], axis=1)
    total = np.full(len(y), np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1)))
    paths: set = set()
    random = np.random.default_rng(23)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        part = np.flatnonzero(random.random(len(y)) < 0.7)       # another part for every tree
        step = np.zeros(len(y))
        _grow(bins, cuts, weight * (p - y), weight * p * (1 - p), part, DEPTH, (), paths, step)
        total = total + RATE * step
    rules = [Rule(c) for c in sorted(paths)]
    shares = [r.holds(x).mean() for r in rules]
    return [r for r, s in zip(rules, shares) if LEAST_SHARE <= s <= 1 - LEAST_SHARE]


def lasso(held: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 150) -> np.ndarray:
    """Weights (the last one is the free bias) of the L1-penalized logistic model, by accelerated proximal gradients."""
    x = np.hstack([held, np.ones((len(held), 1))])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    rate = 4 / np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        moved = ahead - rate * (x.T @ (weight * (p - y)))
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new[-1] = moved[-1]
        again = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + (momentum - 1) / again * (new - w)
        w, momentum = new, again
    return w


def _loss(held: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> float:
    total = np.clip(held @ w[:-1] + w[-1], -40, 40)
    return float((weight * (np.log1p(np.exp(total)) - y * total)).sum() / weight.sum())


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Model of rows of statistics `x` with labels `y`; a row stands for `weight` rows. Without rows the score is 0.5, with one
    class only it is that class."""
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else 40.0 if y[0] else -40.0, ())
    weight = np.minimum(weight / weight.min(), CLASS_WEIGHT)
    weight = weight / weight.sum()
    rules = extracted(x, y, weight * len(y))
    if not rules:
        rate = (weight * y).sum()
        return Model(float(np.log(rate / (1 - rate))), ())
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    out = np.random.default_rng(5).random(len(y)) < 0.2
    if out.any() and not out.all():
        paths, losses = [], []
        w = None
        for penalty in PENALTIES:
            w = lasso(held[~out], y[~out], weight[~out] / weight[~out].sum(), penalty, w)
            paths.append(penalty)
            losses.append(_loss(held[out], y[out], weight[out], w))
        chosen = next(p for p, loss in zip(paths, losses) if loss <= NEAR * min(losses))
    else:
        chosen = PENALTIES[len(PENALTIES) // 2]
    w = lasso(held, y, weight, chosen, steps=600)
    return Model(float(w[-1]), tuple(Rule(r.conditions, float(v)) for r, v in zip(rules, w[:-1]) if abs(v) > NO_WEIGHT))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold. A document labelled more than once is of low
    quality if any of its labels says so; NULL labels teach nothing."""
    known = (
        labels.where(F.col("quality").isNotNull() & learnable(F.col("doc_id"), FOLDS, HELD))
        .groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_class / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1_000_000)) < share * 1_000_000
    ids = F.broadcast(known.where(drawn))  # about 2 * per_class ids whatever the size of the table
    texts = capped(docs.select("doc_id", "text").join(ids, "doc_id"), "label", 2 * per_class)
    rows = described(texts).select(F.col("row.label").alias("label"), *STATISTICS).collect()
    rows.sort()
    table = np.array([list(r) for r in rows], float).reshape(len(rows), len(STATISTICS) + 1)
    y = table[:, 0]
    return fit(table[:, 1:], y, np.array([max(1.0, counts[int(v)] / per_class) for v in y]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> (row, score, predicted): the probability of label 1 from the text alone. NULL and empty texts are scored like any
    other, by the statistics of an empty text; repeated rows get the same score each."""
    scored = described(docs).select("row", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("row.doc_id", is_fold(F.col("row.doc_id"), FOLDS, HELD).alias("held_out"), "score", "predicted")
