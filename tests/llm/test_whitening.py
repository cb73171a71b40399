"""Whitening against a dense eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import whitening
from talus.llm.whitening import Spectrum, secular_roots


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(1e-9, 1e9), min_size=1, max_size=12, unique=True), st.floats(1e-6, 1e6), st.integers(0, 1000))
def test_secular_roots(values, rho, seed):
    d = np.sort(np.array(values))
    d = d[np.append(True, np.diff(d) > 1e-12 * d[-1])]
    z = np.random.default_rng(seed).normal(size=len(d))
    z[np.abs(z) < 1e-3] = 1e-3
    apart, roots = secular_roots(d, z * z, rho)
    exact = np.linalg.eigvalsh(np.diag(d) + rho * np.outer(z, z))
    assert np.allclose(roots, exact, rtol=0, atol=1e-12 * exact[-1])
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()          # one between every two old ones
    assert np.allclose(d[None, :] - roots[:, None], apart, rtol=0, atol=1e-12 * exact[-1])


SHAPES = [
    np.random.default_rng(0).normal(0, 100, (300, 16)) + 1e5,
    np.random.default_rng(1).integers(0, 3, (200, 10)).astype(float),
    np.eye(12)[np.random.default_rng(2).integers(0, 12, 300)] * 7,         # equal eigenvalues
    np.ones((20, 5)) * 3,
    np.repeat(np.random.default_rng(3).normal(size=(2, 6)), 50, axis=0),   # rank one
    np.concatenate([np.random.default_rng(4).normal(0, s, (50, 8)) for s in (1e6, 1e-3)]),
    np.diag([1.0, 1.0, 1.0, 5.0]),
]


@pytest.mark.parametrize("number", range(len(SHAPES)))
@pytest.mark.parametrize("parts,block", [(1, 1), (3, 1), (4, 50), (1, 10_000)])
def test_spectrum_of_any_order_and_split(number, parts, block):
    x = SHAPES[number]
    pieces = []
    for part in np.array_split(x, parts):
        held = Spectrum(x.shape[1])
        for i in range(0, len(part), block):
            held.add_block(part[i:i + block])
        pieces.append(held)
    held = pieces[0]
    for other in pieces[1:]:
        held.combine(other)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    size = max(np.abs(scatter).max(), 1e-300)
    assert held.n == len(x) and np.allclose(held.mean, x.mean(axis=0), rtol=1e-12, atol=1e-9)
    assert np.abs((held.vectors.T * held.roots) @ held.vectors - scatter).max() <= 1e-11 * size
    assert np.abs(held.vectors @ held.vectors.T - np.eye(len(held.vectors))).max(initial=0) < 1e-12
    assert (np.diff(held.roots) >= 0).all()


def plain(rows):
    """(vec_id, component) -> (n, deviation, |whitened|, explained)"""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    return {(i, k + 1): (n, deviation[row], abs(white[row, k]), values[order[k]] / values.sum())
            for row, (i, _) in enumerate(kept) for k in range(len(order))}, white


SCHEMA = "vec_id long, embedding array<float>, n long, component int, x string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)


def test_digest_against_dense(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(0, 0.3, (600, 12)) * np.linspace(1, 0.2, 12) + 0.1)]
    rows += [(7, rows[7][1]), (900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12)]
    want, _ = plain(rows)
    got = whitening.digest(frame(spark, rows).repartition(5)).collect()
    assert len(got) == 601 * 8
    signs = {}
    for g in got:
        n, deviation, white, share = want[g.vec_id, g.component]
        assert g.n == n and g.deviation == deviation
        assert abs(g.whitened) == pytest.approx(white, rel=1e-8, abs=1e-9) and g.explained == pytest.approx(share, rel=1e-9)
        assert g.identity_error < 1e-10
        signs.setdefault(g.component, []).append((g.vec_id, g.whitened))


def test_tree_of_spectra(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (900, 5)) * [5, 4, 3, 2, 1]
    numbers = whitening.numbers(frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]).repartition(40))
    held, sums = whitening.spectrum(numbers.select("x"), 5, fan_in=4)
    whole = np.array([r.x for r in numbers.collect()], float)
    centred = whole - whole.mean(axis=0)
    assert held.n == 900 and list(sums) == list(whole.sum(axis=0).astype(int))
    assert np.allclose(held.roots, np.linalg.eigvalsh(centred.T @ centred), rtol=1e-12)


def test_degenerate_tables(spark):
    assert whitening.digest(frame(spark, [])).count() == 0
    assert whitening.digest(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.digest(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in sorted(one)] == [
        (i, k, None, None, None, 0) for i in (1, 2) for k in (1, 2)]
    two = whitening.digest(frame(spark, [(1, [0.5, 0.25, 3.0]), (2, [0.5, 0.75]), (None, [0.5, 0.25, 3.0])])).collect()
    assert len(two) == 9 and {r.component for r in two if r.whitened is not None} == {1}
    assert all(r.explained == pytest.approx(1.0) for r in two if r.component == 1)
    assert all(r.explained == 0 for r in two if r.component > 1)
    assert sum(r.whitened ** 2 for r in two if r.component == 1) == pytest.approx(3)


def test_deviation_is_exact_beyond_doubles():
    x = np.array([[100_000 + 3 ** 20, 5], [1, 2]], np.int64)
    centre = whitening.Centre(3, np.array([7, 11]))
    exact = [min(sum((3 * int(a) - s) ** 2 for a, s in zip(r, (7, 11))), (1 << 63) - 1) for r in x]
    assert [int(v) for v in centre.deviation(x)] == exact
    assert whitening.Centre(10 ** 9, np.array([0, 0])).deviation(x)[0] == (1 << 63) - 1
