"""Polygon cells against ray casting over all edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talus.operators import polygons

SCHEMA = "feature long, name string, rings array<struct<part: int, ring: int, points: array<struct<x: double, y: double>>>>"


def crossings(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip([ring[-1], *ring[:-1]], ring):
        if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / ((ay - by) or 1e-15) + bx:
            odd = not odd
    return odd


def first_feature(shapes, x, y):
    for feature, parts in shapes:
        if any(crossings(p[0], x, y) and not any(crossings(h, x, y) for h in p[1:]) for p in parts):
            return feature
    return None


def star(r, cx, cy, size, n):
    at = [(2 * math.pi * k / n, size * r.uniform(0.2, 1)) for k in range(n)]
    ring = [(cx + d * math.cos(t), cy + d * math.sin(t)) for t, d in at]
    return ring + ring[:1] if r.random() < 0.5 else ring


def comb(cx, cy, teeth):
    """Many nearly vertical edges side by side, some of them exactly on cell borders, and a flat edge below."""
    out = [(cx, cy)]
    for k in range(teeth):
        out += [(cx + 0.05 * k, cy + 1.0), (cx + 0.05 * k + 0.025, cy + (0.05 if k % 3 else 0.5)), (cx + 0.05 * k + 0.025, cy + 0.05)]
    return out + [(cx + 0.05 * teeth, cy)]


def shapes_and_points():
    r = random.Random(12)
    shapes = [(0, [[star(r, 88, 27, 1.0, 9), star(r, 88, 27, 0.15, 5)], [star(r, 90, 27, 0.4, 4)]]),
              (1, [[comb(88.5, 26.0, 30)]]), (2, [[star(r, 89, 26.8, 1.2, 60), star(r, 89, 26.8, 0.2, 12), star(r, 89.5, 26.9, 0.1, 3)]]),
              (3, [[[(87.0, 26.0), (91.0, 26.0), (91.0, 28.0), (87.0, 28.0)]]]),
              (5, [[[(86.0, 25.0), (86.0, 25.0), (92.0, 25.3), (92.0, 25.3), (91.0, 25.0)]]])]
    points = [(r.uniform(85.5, 92.5), r.uniform(24.8, 28.5)) for _ in range(3000)]
    for _, parts in shapes:
        for part in parts:
            for ring in part:
                points += ring[:40] + [(x + 1e-9, y - 1e-9) for x, y in ring[:10]]
    points += [(round(x, 1), round(y, 1)) for x, y in points[:400]] + [(x, 26.0) for x, _ in points[:100]] + [(88.0, y) for _, y in points[:100]]
    return shapes, points


def frame(spark, shapes):
    rows = [(f, None if f == 1 else f"n{f}", [(p, k, ring) for p, part in enumerate(parts) for k, ring in enumerate(part)]) for f, parts in shapes]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [0.05, 0.1, 0.37, 2.0])
def test_every_point_as_by_ray_casting(spark, size):
    shapes, points = shapes_and_points()
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "id long, latitude double, longitude double")
    got = {r["id"]: (r["region_feature"], r["region"]) for r in polygons.locate(df, frame(spark, shapes), size=size).collect()}
    for i, (x, y) in enumerate(points):
        want = first_feature(shapes, x, y)
        assert got[i] == (want, None if want in (None, 1) else f"n{want}"), (x, y)
    assert len({v for v, _ in got.values()}) == 6


def test_a_ring_of_many_vertices(spark):
    """Cells hold the edges that touch them, whatever the ring's length: together about as many as there are edges."""
    n = 100_000
    ring = [(88 + (1 + 0.2 * math.sin(40 * 2 * math.pi * k / n)) * math.cos(2 * math.pi * k / n),
             27 + (1 + 0.2 * math.sin(40 * 2 * math.pi * k / n)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    shapes = frame(spark, [(7, [[ring]])])
    table = polygons.cover(shapes).select(F.col("candidates")[0].alias("c")).select(F.size("c.edges").alias("n")).where("n > 0")
    held = table.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    assert n <= held["all"] <= 1.2 * n and held["most"] < 3000
    r = random.Random(1)
    points = [(r.uniform(86.7, 89.3), r.uniform(25.7, 28.3)) for _ in range(300)]
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "id long, latitude double, longitude double")
    got = {x["id"]: x["region_feature"] for x in polygons.locate(df, shapes).collect()}
    assert all(got[i] == (7 if crossings(ring, *p) else None) for i, p in enumerate(points))


def test_the_same_polygons_for_both_levels_are_covered_once(spark, monkeypatch):
    shapes = frame(spark, [(7, [[[(87.0, 26.0), (91.0, 26.0), (91.0, 28.0), (87.0, 28.0)]]])])
    calls, cover = [], polygons.cover
    monkeypatch.setattr(polygons, "cover", lambda *a: calls.append(1) or cover(*a))
    events = spark.createDataFrame([(1, 27.0, 88.0, None), (2, 27.0, 88.0, "given")], "id long, latitude double, longitude double, state string")
    rows = {r["id"]: (r["state"], r["district"]) for r in polygons.fill_places(events, shapes, shapes.select("*")).collect()}
    assert rows == {1: ("n7", "n7"), 2: ("given", None)} and len(calls) == 1
