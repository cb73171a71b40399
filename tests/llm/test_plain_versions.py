"""Draws of the mixture and adaptive verdicts of the quality rules against plain code."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from talus.llm import mixing, quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    return [(i, " ".join(word() for _ in range(r.choice([3, 40, 80, 400 if i % 97 == 0 else 60]))), None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def plain_draws(rows, want):
    """doc -> times drawn, from (source, size, key) rows: large documents by their share of the target, small ones make up the rest,
    whole rounds of the keyed order until the middle of a document lies beyond the wanted length."""
    by_source = defaultdict(list)
    for i, source, size, key in rows:
        by_source[source].append((key, size, i))
    taken = {}
    for source, docs in by_source.items():
        total = sum(size for _, size, _ in docs)
        drawn = 0
        for large in (True, False):
            line = sorted(d for d in docs if (d[1] * mixing.LARGE > total) == large)
            words = sum(size for _, size, _ in line)
            wanted = want[source] * words / max(1, total) if large else want[source] - drawn
            upto, here = 0, 0
            for _, size, i in line:
                upto += size
                taken[i] = sum(words > 0 and upto - size / 2 + n * words < wanted for n in range(mixing.CAP))
                here += taken[i] * size
            drawn += here
    return taken


@pytest.mark.parametrize("n,seed", [(40, 1), (600, 2)])
def test_mixture_draws(spark, n, seed):
    docs = spark.createDataFrame(corpus(n, seed), SCHEMA).repartition(3)
    rows = [(r.doc_id, r.source, r["size"], r.key) for r in mixing._sized(docs).select("row.doc_id", "source", "size", "key").collect()]
    order = ["a", "b", "c", None]
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in order]
    want = dict(zip(order, brute.targets(sizes)))
    expected = plain_draws(rows, want)
    got = {r.doc_id: (r.taken, len(r.shards), r["size"]) for r in mixing.digest(docs).collect()}
    for i, (taken, copies, size) in got.items():
        assert copies == expected[i] and taken == copies * size
    # Every copy is in one shard, and the shards' parts of a source add up to its draw.
    found = mixing.mixed(docs).select("row.doc_id", "row.source", "shard").collect()
    assert len(found) == sum(expected.values()) and {r.shard for r in found} <= set(range(mixing.SHARDS))


def percentile(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def plain_verdicts(rows):
    """doc -> kept, by quartiles of its group, its language, or the whole."""
    facts = {}
    for i, text, lang, source in rows:
        n, chars, symbols, dup, _, failed = brute.quality(text)
        lines = [x for x in (text or "").split("\n") if brute.words(x)]
        ratios = {"symbol_ratio": symbols / chars if chars else None, "word_length": chars / n if n else None,
                  "line_ratio": dup / len(lines) if lines else None}
        facts[i] = (lang, source, failed, ratios)
    passed = [f for f in facts.values() if not f[2]]
    out = {}
    for i, (lang, source, failed, ratios) in facts.items():
        own = [f[3] for f in passed if f[:2] == (lang, source)]
        of_lang = [f[3] for f in passed if f[0] == lang]
        used = own if len(own) >= quality.GROUP_ROWS else of_lang if len(of_lang) >= quality.GROUP_ROWS else [f[3] for f in passed]
        ok = not failed
        for name, (least, both) in quality.RATIOS.items():
            values = [u[name] for u in used if u[name] is not None]
            if not values or ratios[name] is None:
                continue
            q1, q3 = percentile(values, 0.25), percentile(values, 0.75)
            room = quality.SPREAD * max(q3 - q1, least)
            ok = ok and ratios[name] <= q3 + room and (not both or ratios[name] >= q1 - room)
        out[i] = ok
    return out


def test_adaptive_verdicts(spark):
    """A large group, small groups of a large language, and small languages are each judged by the right quartiles."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = []
    groups = [("en", "big", 150, 4), ("en", "s1", 40, 5), ("en", None, 20, 5), ("fr", "s1", 60, 6), ("fr", "s2", 70, 11), ("xx", "s1", 8, 4), (None, "s2", 5, 4)]
    for lang, source, n, length in groups:
        for k in range(n):
            ws = [word(max(1, length + r.randrange(-2, 3))) for _ in range(60)]
            if k % 9 == 0:
                ws = [w + r.choice(["", "#$%"]) for w in ws]
            if k % 13 == 0:
                ws = [w * 4 for w in ws]
            text = " ".join(ws)
            if k % 17 == 0:
                text = "\n".join([*ws[:20], *(["same line"] * 12), *ws[20:]])
            rows.append((len(rows), text, lang, source))
    rows += [(5000, "too short", "en", "big"), (5001, None, "fr", "s1"), (5002, "", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {x.doc_id: x.kept for x in quality.digest(docs).collect()}
    want = plain_verdicts(rows)
    assert got == want and 10 < sum(not v for v in want.values()) < len(rows) / 2


def test_repeated_rows_are_judged_each(spark):
    docs = spark.createDataFrame(corpus(30, 3), SCHEMA)
    twice = quality.digest(docs.union(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("kept").alias("k")).collect()
    assert all((r.n, r.k) == (2, 1) for r in twice)
