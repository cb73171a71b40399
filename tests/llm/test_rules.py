"""The quality classifier: statistics against plain code, compiled rules against the rules themselves, held-out accuracy."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import rules
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, label int, words string, n int, score string, row int"


def plain(text):
    text = text or ""
    ws = brute.words(text)
    n, solid = len(ws), sum(map(len, ws))
    lines = [x for x in text.split("\n") if brute.words(x)]
    of = lambda a, b: a / b if b else 0.0
    share = lambda pattern: of(len(re.findall(pattern, text)), solid)
    return (float(n), of(solid, n), share(r"[#*$%&|<>]"), share("[A-Z]"), share("[0-9]"), share(r"[.,;:?'\"()\-]"), share("!"),
            of(len(set(ws)), n), of(sum(a == b for a, b in zip(ws, ws[1:])), n), of(len(lines) - len(set(lines)), len(lines)),
            of(n, len(lines)))


TEXTS = [None, "", " \n\t ", "One two two three.\nOne two two three.\n\nx", "A#B $5 !! 日本 é", "word " * 50_000, "a\x0bb\x0cc\r\nd",
         "Hello (world), it's \"fine\"; really: yes - 12%?"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "w", 2, "s", 3) for i, t in enumerate(texts)], SCHEMA)


def test_statistics(spark):
    got = rules.described(frame(spark, TEXTS)).select("row.doc_id", "row.score", *rules.STATISTICS).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.score == "s" and tuple(r)[2:] == pytest.approx(plain(TEXTS[r.doc_id]))


def made(n=900, seed=0):
    r = np.random.default_rng(seed)
    x = r.random((n, len(rules.STATISTICS)))
    y = ((x[:, 2] <= 0.4) & (x[:, 7] > 0.3) | (x[:, 5] > 0.9)).astype(float)
    return x, y


def test_rules_are_paths_that_find_the_interaction():
    x, y = made()
    found = rules.extracted(x, y, np.ones(len(y)))
    assert all(len({(k, a) for k, a, _ in r.conditions}) == len(r.conditions) <= rules.DEPTH for r in found)
    model = rules.fit(x, y, np.ones(len(y)))
    total = lambda m, x: m.bias + sum((r.weight * r.holds(x) for r in m.rules), np.zeros(len(x)))
    fresh, truth = made(seed=1)
    assert ((total(model, fresh) > 0) == (truth == 1)).mean() > 0.93
    assert 0 < len(model.rules) < len(found) / 2             # the penalty drops most of them


def test_lasso_is_optimal():
    r = np.random.default_rng(3)
    held = (r.random((400, 12)) < 0.4).astype(float)
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * held[:, 0] - 1.5 * held[:, 1])))).astype(float)
    weight, penalty = np.full(400, 1 / 400), 0.02
    w = rules.lasso(held, y, weight, penalty, steps=4000)
    slope = np.hstack([held, np.ones((400, 1))]).T @ (weight * (1 / (1 + np.exp(-(held @ w[:-1] + w[-1]))) - y))
    assert abs(slope[-1]) < 1e-6 and (w[:-1] == 0).any()
    for value, s in zip(w[:-1], slope):
        assert abs(s + penalty * np.sign(value)) < 1e-6 if value else abs(s) <= penalty + 1e-6


def test_compiled_rules_equal_the_rules(spark):
    model = rules.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in rules.score(docs, model).select("row.doc_id", "score", "predicted").collect()}
    for d in docs.collect():
        x = np.array([plain(d.text)])
        total = model.bias + sum(r.weight * float(r.holds(x)[0]) for r in model.rules)
        assert got[d.doc_id].score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
        assert got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.3)
    assert all(str(r) for r in model.rules)


def test_held_out_accuracy_without_python_in_the_plan(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = rules.digest(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    rows = out.where("held_out").join(labels, "doc_id").collect()
    for quality, least in ((0, 0.9), (1, 0.97)):
        own = [r.predicted == quality for r in rows if r.quality == quality]
        assert len(own) > 5 and sum(own) >= least * len(own)


def test_tables_with_little_to_learn(spark):
    docs = frame(spark, TEXTS).unionByName(frame(spark, TEXTS))
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, text string")
    scores = lambda rows: {r.score for r in rules.digest(docs, labels(rows)).collect()}
    assert scores([]) == scores([(0, None, "x"), (None, 1, "x")]) == {0.5}
    assert max(scores([(1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (3, 0, "x"), (4, 0, "x")])) < 1e-9
    assert min(scores([(i, 1, "x") for i in range(8)])) > 1 - 1e-9
    assert rules.digest(docs.limit(0), labels([(1, 0, "x"), (2, 1, "x")])).count() == 0
    two = rules.digest(docs, labels([(i, i % 2, "x") for i in range(1, 8)]))
    assert two.count() == 2 * len(TEXTS) and two.where("score between 0 and 1").count() == 2 * len(TEXTS)


def test_a_repeated_labelled_row_is_drawn_a_bounded_number_of_times(spark):
    many = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"), F.lit(0).alias("label"))
    one = spark.createDataFrame([(2, "other", 1)], "doc_id int, text string, label int")
    got = rules.capped(many.union(one), "label", 100).groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in got} == {(0, 100), (1, 1)}


