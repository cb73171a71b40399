"""Clustering, components, greedy quotas and model plumbing against brute force."""

import datetime as dt
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talus import vocab
from talus.operators import cluster, evaluation, features, model, sampling
from talus.plans import zones
from talus.runtime import shared_dir


def dbscan(points, eps, least):
    """Textbook clustering by list scans; cluster = smallest core id, noise = own id."""
    out = {}
    for state in {p[1] for p in points}:
        mine = sorted(p for p in points if p[1] == state)
        near = {p[0]: [q[0] for q in mine if math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) <= eps] for p in mine}
        core = {i for i, n in near.items() if len(n) >= least}
        label = {}
        for i in sorted(core):
            if i in label:
                continue
            todo = [i]
            while todo:
                j = todo.pop()
                if j in label:
                    continue
                label[j] = i
                todo += [k for k in near[j] if k in core]
        for i in near:
            reach = [label[j] for j in near[i] if j in core]
            out[i] = label.get(i, min(reach) if reach else i)
    return out


def field(rng):
    rows = []
    for i in range(40):
        rows.append(("A", 10.0, 20.0))
    for i in range(120):
        rows.append(("A", 10 + rng.gauss(0, 0.05), 20.3 + rng.gauss(0, 0.05)))
    for i in range(60):
        rows.append((rng.choice("AB"), 9 + 3 * rng.random(), 19 + 3 * rng.random()))
    for i in range(50):
        rows.append(("C", -5.0, -7 + i * 0.0999))
    rng.shuffle(rows)
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("least,direct", [(1, 4096), (1, 4), (4, 4096), (4, 6)])
def test_clusters_equal_textbook(spark, least, direct):
    points = field(random.Random(2))
    df = spark.createDataFrame(points, "id long, state string, latitude double, longitude double")
    got = {r["id"]: r["cluster"] for r in cluster.cluster(df.repartition(5, "latitude"), 0.1, least, direct).collect()}
    assert got == dbscan(points, 0.1, least)


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_of_long_chains(spark, monkeypatch, small):
    monkeypatch.setattr(cluster, "SMALL_GRAPH", small)
    monkeypatch.setattr(cluster, "HUB", 2)
    chain = [(i, i + 1) for i in range(0, 300) if i % 100 != 99]
    rng = random.Random(4)
    rename = list(range(302))
    rng.shuffle(rename)
    edges = [(rename[a], rename[b]) for a, b in chain]
    nodes = spark.range(302).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in cluster.connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for start in (0, 100, 200):
        members = [rename[i] for i in range(start, start + 100)]
        want |= {m: min(members) for m in members}
    want |= {rename[i]: rename[i] for i in (300, 301)}
    assert got == want


def test_zone_names():
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    df = session.createDataFrame([("S", 1, 1), ("S", 2, 3)], "s string, i int, k int")
    assert [r[0] for r in df.select(zones.zone_name(F.col("s"), F.col("i"), F.col("k"))).collect()] == [
        "S (Historical Cluster)", "S Region 2 (Historical Cluster)"]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_quotas_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    slopes, covers = ["<10", "10-20", "unknown"], ["forest", "water", "urban"]
    rows = [(i, rng.choice(slopes), rng.choice(covers)) for i in range(3000) if rng.random() < 0.7]
    slope_quota = {"<10": rng.randint(0, 60), "10-20": rng.randint(20, 90)}
    cover_quota = {"forest": rng.randint(10, 50), "water": rng.randint(0, 40)}
    count = rng.randint(60, 400)
    taken, used = [], {}
    for i, s, c in rows:
        if len(taken) >= count:
            break
        if used.get(s, 0) >= slope_quota.get(s, 1e9) or used.get(c, 0) >= cover_quota.get(c, 1e9):
            continue
        taken.append(i)
        used[s], used[c] = used.get(s, 0) + 1, used.get(c, 0) + 1
    df = spark.createDataFrame(rows, "attempt_id long, slope_key string, landcover_key string")
    state = sampling.accept(df, 0, 3000, count, slope_quota, cover_quota)
    got = sorted(r[0] for r in df.where(state.condition()).select("attempt_id").collect())
    assert got == taken and state.taken == len(taken)


def test_attempts_are_stored_by_number_and_the_taken_ones_drawn_again(spark, monkeypatch):
    """A block of attempts was stored with all its columns, some hundred bytes for each."""
    judged = []

    def passed(df, *rest):
        judged.append(df.columns)
        return df.withColumns({"slope_degrees": F.lit(3.0), "landcover_category": F.lit("forest"), "slope_key": F.lit("a"), "landcover_key": F.lit("forest"),
                               "rejected_by": F.when(F.col("attempt_id") % 3 == 0, "buffer"), "region": F.concat(F.lit("some region of a long name "), "attempt_id")})

    monkeypatch.setattr(sampling, "stage", passed)
    size = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark)).rglob("*") if f.is_file())
    before, box, first = size(), (26.0, 88.0, 28.0, 90.0), dt.datetime(2020, 1, 1)
    samples, stats = sampling.generate(spark, None, 20_000, box, first, 30, None, None, seed=5)
    assert size() - before < 20 * 80_000
    got = {r["attempt_id"]: r for r in samples.collect()}
    want = {r["attempt_id"]: r for r in sampling.candidates(spark, 0, 80_000, box, first, 30, 5).where("attempt_id % 3 <> 0").orderBy("attempt_id").limit(20_000).collect()}
    assert samples.columns == ["point_id", "latitude", "longitude", "as_of", "slope_degrees", "landcover_category", "attempt_id"]
    assert {k: tuple(r)[:4] for k, r in got.items()} == {k: tuple(r)[1:5] for k, r in want.items()}
    assert {r["outcome"]: r["attempts"] for r in stats.collect()}["accepted"] == 20_000


def test_candidates_do_not_depend_on_partitioning(spark):
    make = lambda: sampling.candidates(spark, 0, 500, (26.0, 88.0, 28.0, 90.0), "2020-01-01 00:00:00", 30, 9)
    first = {tuple(r) for r in make().collect()}
    second = {tuple(r) for r in make().repartition(7).collect()}
    assert first == second and len(first) == 500
    lat = [r[2] for r in first]
    assert min(lat) >= 26 and max(lat) <= 28 and abs(sum(lat) / 500 - 27) < 0.1


def test_metrics_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame([(y, s, int(s >= 0.5)) for y, s in rows], "label int, score double, prediction int")
    pos, neg = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    area = sum((a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in rows if a[0] for b in rows if not b[0]) / (pos * neg)
    ap, tp, fp = 0.0, 0, 0
    for score in sorted({s for _, s in rows}, reverse=True):
        gain = sum(1 for y, s in rows if s == score and y)
        tp, fp = tp + gain, fp + sum(1 for y, s in rows if s == score and not y)
        ap += gain / pos * tp / (tp + fp)
    assert evaluation.roc_area(df).first()[0] == pytest.approx(area, abs=1e-4)
    assert evaluation.average_precision(df).first()[0] == pytest.approx(ap, abs=1e-4)
    assert evaluation.average_precision(df.where("label = 1")).first()[0] is None


def test_a_class_never_predicted_scores_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in evaluation.class_metrics(df).collect()}
    assert got == {0: (0.5, 1.0, 0.6667, 1), 1: (0.0, 0.0, 0.0, 1)}


def feature_rows(spark, n=200):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((f"p{i}", f"2020-01-{1 + i % 28:02d}", y, *[float(rng.gauss(5 + 4 * y, 2)) for _ in vocab.NUMERIC_FEATURES],
                     None if i % 5 else 90.0, rng.choice(vocab.LANDCOVER_CATEGORIES), True, True))
    names = ", ".join(f"{n} double" for n in vocab.NUMERIC_FEATURES)
    df = spark.createDataFrame(rows, f"point_id string, as_of string, label int, {names}, aspect_degrees double, landcover_category string, "
                                     "terrain_available boolean, landcover_available boolean")
    return df.withColumn("as_of", F.to_timestamp("as_of").cast("timestamp_ntz"))


def test_forest_learns_and_withholds_incomplete_rows(spark):
    rows = feature_rows(spark)
    split = evaluation.time_split(rows, "as_of", ["point_id"])
    assert split.where("is_train").count() == 160
    assert split.where("is_train").agg(F.max("as_of")).first()[0] <= split.where("NOT is_train").agg(F.min("as_of")).first()[0]
    fitted = model.fit_susceptibility(split.where("is_train"), trees=10)
    got = {r["class"]: r for r in model.evaluate(fitted, split.where("NOT is_train")).collect()}
    assert got[1]["roc_auc"] > 0.9 and got[1]["pr_auc"] > 0.8
    holes = rows.withColumn("rainfall_7d", F.when(F.col("point_id") != "p3", F.col("rainfall_7d")))
    scored = {r["point_id"]: r for r in model.score_points(fitted, holes).collect()}
    assert scored["p3"]["probability"] is None and not scored["p3"]["available"]
    assert scored["p1"]["susceptibility_score"] > scored["p0"]["susceptibility_score"]
    weights = model.importances(fitted, features.feature_names())
    assert len(weights) == 17 and abs(sum(w for _, w in weights) - 1) < 0.01


def test_a_large_training_part_is_dealt_over_the_cores(spark):
    """A part of few bytes in one partition uses every core, with the same rows; a small one is left as it is."""
    cores = spark.sparkContext.defaultParallelism
    large = spark.range(model.DEALT_ROWS + 1).coalesce(1)
    out = model.dealt(large)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and max(sizes) <= 2 * min(sizes)
    assert out.agg(F.count("*"), F.sum("id")).first()[:] == large.agg(F.count("*"), F.sum("id")).first()[:]
    assert model.dealt(large.limit(50)).rdd.getNumPartitions() == 1


def test_a_forest_scores_in_a_session_that_has_observed_something(spark):
    # A streaming query makes the session's observation manager, which cannot be sent to a task.
    spark._jsparkSession.observationManager()
    rows = feature_rows(spark)
    fitted = model.fit_susceptibility(rows, trees=2)
    assert not fitted.stages[-1].hasSummary
    assert model.evaluate(fitted, rows).count() == 2
    assert model.score_points(fitted, rows).where("available").count() == rows.count()


def _reads_per_task(spark, run):
    """Shuffle records read by every task of the stages that `run` causes."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    context.setJobGroup("reads", "reads")
    try:
        run()
    finally:
        context._jsc.clearJobGroup()
    stages = {}
    for job in tracker.getJobIdsForGroup("reads"):
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                tasks = jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.taskList(stage, 0, 1000))
            except Exception:  # noqa: BLE001 - a stage that was skipped has no tasks
                continue
            stages[stage] = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined()]
    return stages


@pytest.mark.parametrize("small", [0, 100_000])
def test_the_leaves_of_a_star_do_not_meet_in_one_task(spark, monkeypatch, small):
    monkeypatch.setattr(cluster, "SMALL_GRAPH", small)
    n = 100_000
    nodes, hub = spark.range(n + 1).toDF("node"), F.lit(n).cast("long")
    edges = spark.range(n).repartition(8).select(F.col("id").alias("a"), hub.alias("b"))
    options = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        result = {}
        reads = _reads_per_task(spark, lambda: result.update(r=cluster.connected_components(nodes, edges).groupBy("component").count().collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r["component"], r["count"]) for r in result["r"]] == [(0, n + 1)]
    # Tasks of a union that read stored rows read nothing from a shuffle.
    heavy = [sorted(x for x in t if x) for t in reads.values() if sum(t) > n / 2]
    uneven = [t for t in heavy if len(t) < 8 or t[-1] > 2 * t[len(t) // 2]]
    assert heavy and not uneven, uneven
