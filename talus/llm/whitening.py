"""Whitening of embeddings by an incremental eigendecomposition.

Every partition carries (count, mean, eigenvalues, eigenvectors) of the scatter of the vectors seen so far. A vector v beyond the
mean m adds count / (count + 1) * (v - m)(v - m)^T, a rank-one change of a diagonal matrix in the basis of the eigenvectors: the new
eigenvalues are the roots of the secular equation, one between every two old ones, and the new eigenvectors follow from them. Parts
that cannot change are deflated: directions the vector has no share in, and equal eigenvalues, which are first turned so that only
one of them has a share. A direction not seen before enters with eigenvalue zero.

The spectra of the partitions are combined in a tree: the eigenpairs of one are successive rank-one changes of the other, and so
is the distance of their means. One more pass over all vectors projects them on the combined basis; the eigenvectors of that
small matrix (Rayleigh-Ritz) remove what rounding the updates have gathered. A task holds a batch of vectors and one spectrum
(width squared); the driver gets the combined spectrum and the projected matrix, both of the width squared, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talus.llm.common import row_column
from talus.runtime import cut_lineage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
FAN_IN = 16
BLOCK_ROWS = 4096
NO_SPREAD = 1e-12       # least share of the whole variance that an eigenvalue above zero has
_EPS = np.finfo(float).eps
_LARGEST = float(1 << 52)
_LONG = (1 << 63) - 1
_SPECTRUM = "n long, sums array<long>, mean array<double>, roots array<double>, vectors array<double>"


@np.errstate(all="ignore")
def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho * z z^T for rising, distinct d, rho > 0 and z2 = z * z > 0. They are given as
    differences to the old ones, (new, old) -> d[old] - root[new], which keeps what lies close to an old one exact."""
    n = len(d)
    total = rho * z2.sum()
    gap = np.append(d[1:] - d[:-1], total)
    here = np.arange(n)
    middle = 1 + rho * (z2 / (d[None, :] - (d + gap / 2)[:, None])).sum(axis=1)
    right = (middle < 0) & (here < n - 1)
    origin = np.where(right, here + 1, here)
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    base = d[None, :] - d[origin][:, None]
    beyond = np.minimum(here + 1, n - 1)
    weights = rho * z2
    to_left = np.tri(n) * weights       # of the old values up to a root's own
    enough = 4 * n * _EPS
    tau = (low + high) / 2
    for step in range(200):
        apart = base - tau[:, None]
        inverse = 1 / apart
        value = 1 + inverse @ weights
        inverse *= inverse
        slope = inverse @ weights
        slope_left = np.einsum("ji,ji->j", inverse, to_left)
        low, high = np.where(value < 0, tau, low), np.where(value < 0, high, tau)
        # Two poles next to the root are kept, the rest is taken as constant; the last root has one pole.
        near, far = apart[here, here], apart[here, beyond]
        a = (near + far) * value - near * far * slope
        b = near * far * value
        c = value - near * slope_left - far * (slope - slope_left)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        move[-1] = near[-1] + near[-1] ** 2 * slope[-1] / (value[-1] - near[-1] * slope[-1])
        wanted = tau + move
        outside = ~((wanted > low) & (wanted < high))
        if step % 8 == 7:
            outside |= high - low > np.abs(tau)
        wanted = np.where(outside, (low + high) / 2, wanted)
        exact = np.abs(value) <= enough
        done = exact | (np.abs(wanted - tau) <= 2 * _EPS * np.abs(tau))
        tau = np.where(exact, tau, wanted)
        if done.all():
            break
    return base - tau[:, None], d[origin] + tau


@dataclass
class Spectrum:
    """Count, mean and eigenpairs (roots rising, one row of `vectors` each) of a scatter matrix."""

    width: int
    n: int = 0
    mean: np.ndarray = field(default=None)
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.mean = np.zeros(self.width) if self.mean is None else self.mean
        self.vectors = np.zeros((0, self.width)) if self.vectors is None else self.vectors

    def add(self, x: np.ndarray) -> None:
        """One vector more."""
        beyond = x - self.mean
        self.rank_one(self.n / (self.n + 1), beyond)
        self.n += 1
        self.mean = self.mean + beyond / self.n

    def add_block(self, rows: np.ndarray) -> None:
        """Many vectors more: a rotation (QR) turns them into as many as the width, with the same scatter about their mean."""
        if len(rows) <= 2 * self.width:
            for row in rows:
                self.add(row)
            return
        mean = rows.mean(axis=0)
        turned = np.linalg.qr(rows - mean, mode="r")
        self._merge(len(rows), mean, np.ones(len(turned)), turned)

    def combine(self, other: Spectrum) -> None:
        """The vectors of another spectrum more."""
        if other.n:
            self._merge(other.n, other.mean, other.roots, other.vectors)

    def _merge(self, n: int, mean: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        beyond = mean - self.mean
        both = self.n + n
        for weight, vector in zip(weights, vectors):
            self.rank_one(float(weight), vector)
        self.rank_one(self.n * n / both, beyond)
        self.mean = self.mean + beyond * (n / both)
        self.n = both

    def rank_one(self, rho: float, v: np.ndarray) -> None:
        """roots and vectors of the scatter plus rho * v v^T."""
        size = float(np.linalg.norm(v))
        if rho <= 0 or size == 0:
            return
        z = self.vectors @ v
        if len(self.roots) < self.width:
            rest = v - self.vectors.T @ z
            again = self.vectors @ rest
            rest -= self.vectors.T @ again      # twice is enough for a right angle
            z = z + again
            new = float(np.linalg.norm(rest))
            if new > 64 * _EPS * size:
                self.vectors = np.vstack([rest / new, self.vectors])
                self.roots = np.append(0.0, self.roots)
                z = np.append(new, z)
        d, vectors = self.roots, self.vectors
        bound = 4 * _EPS * max(float(d[-1]) if len(d) else 0.0, rho * size * size)
        active = np.flatnonzero(rho * size * np.abs(z) > bound)
        close = np.flatnonzero(np.diff(d[active]) <= bound)
        if len(close):
            vectors, z = vectors.copy(), z.copy()
            for i in close:                      # turn two equal roots until the first has no share
                p, q = active[i], active[i + 1]
                r = math.hypot(z[p], z[q])
                c, s = z[q] / r, z[p] / r
                vectors[p], vectors[q] = c * vectors[p] - s * vectors[q], s * vectors[p] + c * vectors[q]
                z[p], z[q] = 0.0, r
            active = np.delete(active, close)
        if not len(active):
            self.vectors = vectors
            return
        old = d[active]
        apart, roots = secular_roots(old, z[active] ** 2, rho)
        # The shares for which these roots are exact, so that the vectors stay at right angles.
        between = old[None, :] - old[:, None]
        np.fill_diagonal(between, 1.0)
        ratios = np.abs(apart / between)
        share = np.sqrt(ratios.prod(axis=0)) * np.sign(z[active])
        turn = share[None, :] / apart
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        d, vectors = d.copy(), vectors.copy()
        d[active], vectors[active] = roots, turn @ vectors[active]
        order = np.argsort(d, kind="stable")
        self.roots, self.vectors = d[order], vectors[order]


def numbers(embeddings: DataFrame) -> DataFrame:
    """embeddings -> (row, x): x = floor(1024 * c) + 100000 per entry, within 2^52 of zero. Rows with a NULL vector, or one that
    holds NULL or a non-finite entry, are left out."""
    whole = F.forall("row.embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    long = lambda c: (F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(_LARGEST)), F.lit(-_LARGEST))) + SHIFT).cast("long")
    return embeddings.select(row_column(embeddings)).where(F.col("row.embedding").isNotNull() & whole).select(
        "row", F.transform("row.embedding", long).alias("x"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.full((len(vectors), width), SHIFT, np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _stored(s: Spectrum, sums: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"n": [s.n], "sums": [sums], "mean": [s.mean], "roots": [s.roots], "vectors": [s.vectors.ravel()]})


def _combined(rows: pd.DataFrame) -> tuple[Spectrum, np.ndarray]:
    out, sums = None, 0
    for r in rows.sort_values(["n", "part"], ascending=False).itertuples():
        part = Spectrum(len(r.mean), int(r.n), np.array(r.mean), np.array(r.roots), np.array(r.vectors, float).reshape(-1, len(r.mean)))
        sums = sums + np.array(r.sums, np.int64)
        if out is None:
            out = part
        else:
            out.combine(part)
    return out, sums


def spectrum(x: DataFrame, width: int, fan_in: int = FAN_IN) -> tuple[Spectrum, np.ndarray] | None:
    """Spectrum and exact sums of all vectors; None without any."""
    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = Spectrum(width), np.zeros(width, np.int64)
        for batch in batches:
            rows = _matrix(batch["x"], width)
            sums += rows.sum(axis=0)
            for i in range(0, len(rows), BLOCK_ROWS):
                held.add_block(rows[i:i + BLOCK_ROWS].astype(float))
        if held.n:
            yield _stored(held, sums)

    parts = cut_lineage(x.mapInPandas(scatter, _SPECTRUM).withColumn("part", F.monotonically_increasing_id()))
    left = parts.count()
    while left > fan_in:
        # One row per group of parts; the numbers of the parts are dense inside a partition, so they are hashed.
        slots = -(-left // (fan_in // 2))
        grouped = parts.withColumn("slot", F.pmod(F.xxhash64("part"), F.lit(slots)))
        parts = cut_lineage(
            grouped.groupBy("slot").applyInPandas(lambda rows: _stored(*_combined(rows)), _SPECTRUM)
            .withColumn("part", F.monotonically_increasing_id()))
        left = parts.count()
    rows = parts.toPandas()  # at most fan_in spectra
    return _combined(rows) if len(rows) else None


class Centre:
    """Exact mean of whole numbers: what lies beyond it keeps all its digits."""

    def __init__(self, n: int, sums: np.ndarray) -> None:
        self.n, self.sums = n, sums
        self.whole = sums // n
        self.rest = (sums - n * self.whole) / n

    def beyond(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n * x - sums)^2 per row, exact; past a long at its limit."""
        far = np.abs(x - self.whole).max(initial=0) + 1
        if float(far) ** 2 * float(self.n) ** 2 * max(1, x.shape[1]) < _LONG / 2:
            return ((self.n * (x - self.whole) - (self.sums - self.n * self.whole)) ** 2).sum(axis=1)
        exact = self.n * (x - self.whole).astype(object) - (self.sums - self.n * self.whole)
        return np.minimum((exact * exact).sum(axis=1), _LONG).astype(np.int64)


def second_moments(x: DataFrame, centre: Centre, axes: np.ndarray) -> np.ndarray:
    """Sum over all vectors of y y^T, where y are their coordinates on `axes` (one per row) from the mean."""
    width, size = axes.shape[1], len(axes)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            y = centre.beyond(_matrix(batch["x"], width)) @ axes.T
            total += y.T @ y
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    out = np.zeros((size, size))
    for r in x.mapInPandas(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]  # width squared entries
    return out


@dataclass
class Whitening:
    n: int
    centre: Centre
    axes: np.ndarray        # (components, width), unit length, by falling variance
    variances: np.ndarray   # of the components; zero where there is no spread
    trace: float
    identity_error: float | None

    @property
    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(np.where(self.variances > 0, self.variances, np.nan))[:, None]


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors `x`; None without vectors or where all are empty. A vector shorter than the longest counts
    as filled with zeros. The sign of a component is that which makes its largest entry positive."""
    width = x.agg(F.max(F.size("x"))).first()[0]
    found = spectrum(x.select("x"), width) if width else None
    if found is None:
        return None
    held, sums = found
    centre = Centre(held.n, sums)
    if not len(held.roots):     # all vectors are equal
        return Whitening(held.n, centre, np.eye(width)[:components], np.zeros(min(components, width)), 0.0, None)
    basis, _ = np.linalg.qr(held.vectors.T, mode="complete")    # the rest of the space has no variance but rounding
    small = second_moments(x, centre, basis.T) / held.n
    values, turn = np.linalg.eigh(small)
    order = np.argsort(-values, kind="stable")[:components]
    axes = (basis @ turn[:, order]).T
    largest = np.abs(axes).argmax(axis=1)
    axes *= np.sign(axes[np.arange(len(axes)), largest])[:, None]
    trace = float(np.trace(small))
    variances = np.where(values[order] > NO_SPREAD * trace, values[order], 0.0)
    out = Whitening(held.n, centre, axes, variances, trace, None)
    spread = variances > 0
    if spread.any():
        after = second_moments(x, centre, out.scaled[spread]) / held.n
        out.identity_error = float(np.abs(after - np.eye(len(after))).max())
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """embeddings -> (row, component, n, deviation, whitened, explained, identity_error), one row per remaining vector and
    component. Repeated rows and NULL ids count like any other. Where a component has no spread (fewer different vectors than
    components), `whitened` is NULL and `explained` 0; both are NULL, and the error, too, where all vectors are equal. No rows
    without vectors or entries."""
    x = numbers(embeddings)
    model = fit(x, components)
    if model is None:
        return x.select("row", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                        F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).limit(0)
    shared = x.sparkSession.sparkContext.broadcast(model)   # components x width numbers
    explained = [v / model.trace if model.trace > 0 else None for v in model.variances.tolist()]

    @pandas_udf("deviation long, whitened array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = _matrix(batch, m.axes.shape[1])
            yield pd.DataFrame({"deviation": m.centre.deviation(rows), "whitened": list(m.centre.beyond(rows) @ m.scaled.T)})

    made = x.select("row", project("x").alias("made"))
    shares = F.array(*[F.lit(v).cast("double") for v in explained])
    return made.select("row", "made.deviation", F.posexplode("made.whitened").alias("place", "value")).select(
        "row", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.nanvl("value", F.lit(None).cast("double")).alias("whitened"), F.get(shares, F.col("place")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: up to eight components of every vector without NULL and non-finite entries."""
    return whiten(embeddings.select("vec_id", "embedding")).select(
        "row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
