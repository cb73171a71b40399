"""The near-copy stage against all pairs compared."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from talus.llm import near_copies, simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, node long"


def shingles(text):
    ws = brute.words(brute.lower(text))
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))}


def kept(docs):
    """Smallest id of every group that pairs of similarity 0.8 connect."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sorted({min((d for d, _ in [docs[j] for j in range(len(docs)) if find(j) == find(i)] if d is not None), default=-1)
                   for i in range(len(docs))})


def rows():
    r, out = random.Random(5), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    for i in range(30):
        base = [word() for _ in range(150)]
        out.append((10 * i, " ".join(base)))
        for j in range(r.randrange(4)):
            copy = list(base)
            for at in r.sample(range(150), r.choice([1, 2, 3, 4, 12])):
                copy[at] = word()
            out.append((10 * i + j + 1, " ".join(copy)))
    base = [word() for _ in range(150)]
    for i in range(40):  # many copies of one text that differ from each other
        copy = list(base)
        copy[3 * i] = word()
        out.append((1000 + i, " ".join(copy)))
    return out + [(2000, "A b"), (2001, "a\n b "), (2002, "a b c"), (2003, None), (2004, " "), (None, "a b"), (None, "only here"), (0, out[0][1])]


@pytest.mark.parametrize("part", [3, 1024])
def test_all_near_copies_go(spark, part):
    data = rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], SCHEMA).repartition(5)
    found = near_copies.keep_one(docs, part)
    assert found.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in found.collect()) == kept(data)


def test_stage_drops_copies_beyond_two_bits_of_simhash(spark):
    base = [f"w{i}" for i in range(150)]
    other = [*base]
    for at in (20, 70, 120):
        other[at] = "changed"
    texts = [" ".join(base), " ".join(other), " ".join(base[::-1])]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() > 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]


def test_forest_equals_all_pairs_within_and_across():
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 30, 60)
    sets = []
    for i in range(80):
        own = base if i % 3 else r.integers(0, 1 << 30, 60)
        own = own.copy()
        own[r.choice(60, r.integers(0, 9), replace=False)] = r.integers(0, 1 << 30)
        sets.append(np.unique(own[:r.integers(45, 61)]))
    close = [(i, j) for j in range(80) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    groups = [i // 2 for i in range(80)]

    def joined(pairs, start):
        label = list(start)
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return sorted(sorted(i for i in range(80) if label[i] == x) for x in set(label))

    assert joined(near_copies.linked(sets), range(80)) == joined(close, range(80))
    assert joined(near_copies.linked(sets, groups), groups) == joined(close, groups)
    across = [(i, j) for i, j in close if i < 30 <= j]
    assert joined(near_copies.linked(sets, None, 30), range(80)) == joined(across, range(80))


def test_many_near_copies_of_one_text(spark):
    """Every node is compared with representatives; no bucket is left to be compared whole."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    data = []
    for i in range(3000):
        copy = list(base)
        copy[r.randrange(300)] = f"x{i}"
        data.append((i, " ".join(copy)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    start = time.time()
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [0]
    assert time.time() - start < 60


def test_rows_repeated_with_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (1, "x y z", 4)],
                                 "doc_id long, text string, class int")
    found = near_copies.keep_one(docs).collect()
    assert len(found) == 2 and {(r.doc_id, r.text) for r in found} == {(1, "a b c d e f"), (1, "x y z")}
    assert next(r for r in found if r.text != "x y z")["class"] in (1, 2)


def test_nothing(spark):
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_pipeline_also_links_by_fingerprint(spark):
    """Texts too unlike for the shingles, whose fingerprints op8 links, are near copies for the stage; chains may mix both kinds of links."""
    r, found = random.Random(3), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    while len(found) < 3:
        base = [word() for _ in range(150)]
        for _ in range(40):
            copy = list(base)
            for at in r.sample(range(0, 150, 6), 4):
                copy[at] = word()
            a, b = shingles(" ".join(base)), shingles(" ".join(copy))
            far = 5 * len(a & b) < 4 * len(a | b)
            bits = (simhash.fingerprint(" ".join(base).encode()) ^ simhash.fingerprint(" ".join(copy).encode())).bit_count()
            if far and bits <= 2:
                found.append((base, copy))
                break
    data = []
    for i, (base, copy) in enumerate(found):
        third = [*copy[:-1], word()]   # alike by shingles to the second only
        data += [(10 * i, " ".join(base).upper()), (10 * i + 1, " ".join(copy)), (10 * i + 2, " ".join(third))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in [*data, (90, None), (91, " ")]], SCHEMA)
    assert sorted(x.doc_id for x in near_copies.keep_one(docs).collect()) == [0, 1, 10, 11, 20, 21, 90]
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 10, 20, 90]
