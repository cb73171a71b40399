"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import periodic
from tests.llm import brute


def plain_runs(ws):
    out = []
    for q in range(1, len(ws) // 4 + 1):
        same = [ws[i] == ws[i + q] for i in range(len(ws) - q)] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            if not equal and start is not None:
                part = ws[start:i + q]
                smallest = next(d for d in range(1, q + 1) if all(part[k] == part[k + d] for k in range(len(part) - d)))
                if smallest == q and len(part) >= max(6, 4 * q):
                    out.append((start, len(part), q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    ws = brute.words(text)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(ws)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    found = plain_runs(ws)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(ws) if i not in dropped)))


words = st.lists(st.integers(0, 2), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(words, words, st.integers(1, 12)), min_size=1, max_size=4), st.sampled_from([1, 2, 4, 1 << 17]))
def test_runs_equal_every_period_tried(parts, block):
    texts = [head + unit[:7] * times + head[:2] for head, unit, times in parts]
    kept, periodic.BLOCK = periodic.BLOCK, block       # smaller blocks than the period, too
    try:
        got = periodic.runs(texts)
    finally:
        periodic.BLOCK = kept
    assert [[tuple(map(int, r)) for r in rows] for rows in got] == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("n", [64, 128, 512, 8192, 1 << 13])
def test_correlations_are_exact(n):
    import numpy as np

    r = np.random.default_rng(n)
    blocks, windows = r.integers(0, 3_000_000, (2, n // 2)), r.integers(0, 3_000_000, (2, n))
    got = periodic.correlations(blocks.astype(float), periodic._centred(windows.astype(float)))
    for row in range(2):
        for s in (0, 1, n // 2 - 1):
            exact = sum(int(a) * int(b) for a, b in zip(blocks[row], windows[row][s:]))
            assert (int(got[row, s]) - exact) % periodic.PRIME == 0


def test_long_texts_of_few_words():
    assert [tuple(r) for r in periodic.runs([[0] * 50_000])[0]] == [(0, 50_000, 1)]
    assert [tuple(r) for r in periodic.runs([[7] + [0, 1, 2] * 30_000 + [9]])[0]] == [(1, 90_000, 3)]
    unit = list(range(9000))
    assert [tuple(r) for r in periodic.runs([[-1] + unit * 4 + unit[:5]])[0]] == [(1, 36_005, 9000)]
    assert len(periodic.runs([unit * 3])[0]) == 0


def rows():
    r = random.Random(3)
    texts = [" ".join(r.choice(["ab", "cd", "Ab", "é"]) for _ in range(r.choice([3, 30, 120]))) for _ in range(120)]
    texts += ["a b " * 40, "x " * 9, "\n\t ", "", None, "a\x0bb a\x0cb a b a b", "one two three four five six " * 3, "日本 " * 7]
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (None, "a " * 20), (None, None)]


def test_digest_against_plain_version(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in data], "doc_id long, text string, start int, runs string, a int")
    got = periodic.digest(docs.repartition(3))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain_digest(i, t) for i, t in data), key=key)
    assert any(r.n_runs for r in got.collect())


def test_scan_keeps_the_row_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", 3)], "doc_id long, text string, runs int")
    row = periodic.scan(docs).first()
    assert row.row.runs == 3 and row.n_words == 9 and bytes(row.collapsed) == b"a b c"
    assert [tuple(r) for r in row.runs] == [(0, 8, 2)]
    assert periodic.digest(docs.limit(0)).count() == 0
