"""Point in polygon without a distance or containment primitive.

Polygons are turned once into a table of grid cells. A cell no edge touches is wholly inside or outside a polygon, so most
points are answered by looking up their cell. A cut cell holds the edges that touch it and one bit per ring: whether the edges
further right that cross the cell's lower border are odd in number. A point's ray to the right meets the cell's own edges, which are
tested, and those further right. The number of the latter is odd or even as at the lower border, but for turns: it changes only at
heights where an edge of the cell ends in an edge further right, so it follows from the cell's own edges too. The table grows with
the edges and the covered cells, not with their product, and every answer is that of ray casting against all edges. Locating
points is one equi-join on the cell, with no shuffle of the points while the table is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus import vocab
from talus.functions import geo
from talus.functions.text import once
from talus.runtime import BROADCAST_ROW_LIMIT, broadcast_if_small, cut_lineage

COVER_CELL_DEGREES = 0.05
EDGE_LIMIT = 2_000_000
SLACK = 1e-7                # degrees by which edges are taken for wider than they are computed
NO_ROW = -(1 << 40)  # far below the row of any latitude


def region_name(properties: Column) -> Column:
    """First non-empty name property in the fixed order of name fields."""
    return F.coalesce(*[F.when(properties[f] != "", properties[f]) for f in vocab.REGION_NAME_FIELDS])


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    rise = edge["ay"] - edge["by"]
    at = (edge["ax"] - edge["bx"]) * (y - edge["by"]) / F.when(rise == 0, F.lit(1e-15)).otherwise(rise) + edge["bx"]
    return ((edge["by"] > y) != (edge["ay"] > y)) & (x < at)


def _inside(candidate: Column, x: Column, y: Column, bottom: Column, col: Column) -> Column:
    """Odd crossings of the outer ring and of no hole, for a point of the cell `col` whose lower border is `bottom`."""
    edges = candidate["edges"]

    def turns(height: str, beyond: str):
        # The edge ends here, between the border and the point, in one that lies right of the cell.
        return lambda e: (e[beyond] >= col) & ((e[height] > bottom) != (e[height] > y))

    def odd(ring: Column) -> Column:
        own = F.filter(edges, lambda e: e["ring"] == ring["ring"])
        times = sum((F.size(F.filter(own, test)) for test in (lambda e: _crosses(e, x, y), turns("ay", "ka"), turns("by", "kb"))),
                    ring["odd"].cast("int"))
        return times % 2 == 1

    return F.exists(candidate["rings"], lambda r: (r["ring"] == 0) & odd(r)) & ~F.exists(candidate["rings"], lambda r: (r["ring"] > 0) & odd(r))


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Polygons (feature, name, rings[part, ring, points[x, y]]) to one row per ring edge from a to b, with the vertices before
    and after it."""
    ring = polygons.select("feature", "name", F.explode("rings").alias("r"))
    points, n = F.col("r.points"), F.size("r.points")
    vertex = lambda i: F.get(points, F.pmod(i, n))
    # The edges are built as one array: an exploded row does not carry the whole ring.
    edges = F.transform(points, lambda b, i: F.struct(vertex(i - 2).alias("p"), vertex(i - 1).alias("a"), b.alias("b"), vertex(i + 1).alias("n")))
    rows = ring.select("feature", "name", "r.part", "r.ring", F.explode(edges).alias("e"))
    return rows.select("feature", "name", "part", "ring", *[F.col(f"e.{v}.{c}").alias(f"{v}{c}") for v in "abpn" for c in "xy"])


def _clipped(ax: Column, ay: Column, bx: Column, by: Column, row: Column, size: float) -> tuple[Column, Column]:
    """Least and greatest x of an edge inside a band of rows, a little wider than it can be computed."""
    steep = F.abs(by - ay) >= size
    rise = F.when(steep, by - ay).otherwise(1.0)
    at = lambda y: ax + (F.greatest(F.least(ay, by), F.least(F.greatest(ay, by), y)) - ay) * (bx - ax) / rise
    low, high = at(row * F.lit(size)), at((row + 1) * F.lit(size))
    least = F.when(steep, F.least(low, high)).otherwise(F.least(ax, bx))
    most = F.when(steep, F.greatest(low, high)).otherwise(F.greatest(ax, bx))
    return least - SLACK, most + SLACK


def _columns(x0: Column, x1: Column, size: float) -> tuple[Column, Column]:
    """The last column that lies left of the edge, and the last one that does not lie right of it."""
    return geo.cell(x0, size) - 1, geo.cell(x1, size)


def cover(polygons: DataFrame, size: float = COVER_CELL_DEGREES) -> DataFrame:
    """Cell table: per cell the polygon parts that may contain its points, in feature order.

    One row per cell: (row, col, candidates[feature, part, name, whole, rings, edges]). `edges` is NULL when the whole cell
    is inside the part.
    """
    key = ["feature", "part", "ring", "row"]
    every = cut_lineage(ring_edges(polygons))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    banded = every.withColumn("row", F.explode(F.sequence(geo.cell(low, size), geo.cell(high, size))))
    side = lambda v, w: _columns(*_clipped(*[F.col(c) for c in (f"{v}x", f"{v}y", f"{w}x", f"{w}y")], F.col("row"), size), size)
    own, before, after = side("a", "b"), side("p", "a"), side("b", "n")
    banded = banded.select(*key, "ax", "ay", "bx", "by", once(k=own[0], last=own[1], ka=before[0], kb=after[0]))
    edge = F.struct("ring", "ax", "ay", "bx", "by", "ka", "kb")
    touched = banded.select(*key, edge.alias("edge"), F.explode(F.sequence(F.col("k") + 1, F.col("last"))).alias("col")).groupBy(*key, "col").agg(
        F.collect_list("edge").alias("edges"))
    # Edges that cross the lower border of a row count for all cells left of them: running sums from the right.
    border = F.col("row") * F.lit(size)
    boxes = every.groupBy("feature", "part", "ring").agg(
        F.min("name").alias("name"), *[f(geo.cell(F.col(c), size)).alias(n) for n, f, c in (
            ("r0", F.min, "by"), ("r1", F.max, "by"), ("c0", F.min, "bx"), ("c1", F.max, "bx"))])
    crossing = (
        banded.where((F.col("ay") > border) != (F.col("by") > border)).groupBy(*key, "k").agg(F.count("*").alias("n"))
        .join(broadcast_if_small(boxes.select("feature", "part", "ring", "c1")), ["feature", "part", "ring"])
        .select(*key, F.least("k", F.col("c1") + 1).alias("col"), "n", F.lit(None).cast("string").alias("name"), F.lit(False).alias("cell"))
    )
    cells = boxes.select("feature", "part", "ring", "name", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select(
        "feature", "part", "ring", "row", F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("col"),
        F.lit(0).cast("long").alias("n"), "name", F.lit(True).alias("cell"))
    from_right = Window.partitionBy(*key).orderBy(F.col("col").desc()).rangeBetween(Window.unboundedPreceding, 0)
    parity = cells.unionByName(crossing).withColumn("odd", F.sum("n").over(from_right) % 2 == 1).where("cell").drop("cell", "n")
    met = parity.join(touched, [*key, "col"], "left").where(F.col("odd") | F.col("edges").isNotNull())
    parts = met.groupBy("feature", "part", "row", "col").agg(
        F.min("name").alias("name"), F.collect_list(F.struct("ring", "odd")).alias("rings"),
        F.flatten(F.collect_list(F.coalesce("edges", F.array()))).alias("edges"))
    cut = F.size("edges") > 0
    # Without edges, the cell is inside where it is inside the outer ring and no other ring is left.
    possible = F.exists("rings", lambda r: r["ring"] == 0) & (cut | (F.size("rings") == 1))
    kept = parts.where(possible).select(
        "row", "col",
        F.struct(
            "feature", "part", "name", (~cut).alias("whole"), F.when(cut, F.col("rings")).alias("rings"),
            F.when(cut, F.col("edges")).alias("edges"),
        ).alias("candidate"),
    )
    by_order = lambda a, b: F.when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(
        a["part"] - b["part"]
    )
    return kept.groupBy("row", "col").agg(F.array_sort(F.collect_list("candidate"), by_order).alias("candidates"))


def locate(points: DataFrame, polygons: DataFrame, name: str = "region", size: float = COVER_CELL_DEGREES,
           wanted: Column | None = None) -> DataFrame:
    """Adds the first containing feature (`<name>_feature`) and its name; NULL when none contains it, and for rows that are
    not `wanted`. Those meet no cell, so they are never ray-cast; in a shuffle they spread over rows that no cell has."""
    return _located(points, cut_lineage(_lookup(cover(polygons, size))), name, size, wanted)


def _located(points: DataFrame, table: DataFrame, name: str, size: float, wanted: Column | None) -> DataFrame:
    edges = F.aggregate("candidates", F.lit(0), lambda n, c: n + F.coalesce(F.size(c["edges"]), F.lit(0)))
    cells, weight = table.agg(F.count("*"), F.coalesce(F.sum(edges), F.lit(0))).first()
    if cells <= BROADCAST_ROW_LIMIT and weight <= EDGE_LIMIT:
        table = F.broadcast(table)
    x, y = F.col("longitude"), F.col("latitude")
    bottom = F.col("_prow") * F.lit(size)
    cast = F.get(F.filter("candidates", lambda c: c["whole"] | _inside(c, x, y, bottom, F.col("_pcol"))), F.lit(0))
    answer = F.struct(F.col("candidates")[0]["feature"].alias("feature"), F.col("candidates")[0]["name"].alias("name"))
    row = geo.cell(y, size)
    if wanted is not None:
        row = F.when(wanted, row).otherwise(F.lit(NO_ROW) - F.pmod(F.xxhash64(x, y), F.lit(1 << 20)))
    return (
        points.withColumn("_prow", row).withColumn("_pcol", geo.cell(x, size))
        .join(table, ["_prow", "_pcol"], "left")
        # Only points in cells cut by an edge are ray-cast.
        .withColumn("_hit", F.when(F.col("settled"), answer).otherwise(
            F.when(F.col("settled").isNotNull(), F.transform(F.array(cast), lambda c: F.struct(c["feature"].alias("feature"), c["name"].alias("name")))[0])))
        .withColumn(f"{name}_feature", F.col("_hit.feature"))
        .withColumn(name, F.col("_hit.name"))
        .drop("_prow", "_pcol", "_hit", "candidates", "settled")
    )


def _lookup(table: DataFrame) -> DataFrame:
    """`settled`: the cell lies wholly inside its first candidate, so its points need no test."""
    return table.select(
        F.col("row").alias("_prow"), F.col("col").alias("_pcol"), "candidates",
        F.col("candidates")[0]["whole"].alias("settled"),
    )


def fill_places(events: DataFrame, states: DataFrame | None, districts: DataFrame | None) -> DataFrame:
    """State and district from polygons, only where the row itself gave no state.

    A district given by the file is never used: it stays NULL whenever a state was given.
    """
    out = events
    missing = F.col("state").isNull()
    tables: list[tuple[DataFrame, DataFrame]] = []
    for name, shapes in (("_state", states), ("_district", districts)):
        if shapes is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
            continue
        # The same polygons for both levels are covered once.
        table = next((t for s, t in tables if s.sameSemantics(shapes)), None)
        if table is None:
            table = cut_lineage(_lookup(cover(shapes)))
            tables.append((shapes, table))
        out = _located(out, table, name, COVER_CELL_DEGREES, missing)
    return (
        out.withColumn("district", F.when(missing, F.col("_district")))
        .withColumn("state", F.coalesce("state", "_state"))
        .drop("_state", "_district", "_state_feature", "_district_feature")
    )
