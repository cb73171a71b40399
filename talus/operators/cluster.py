"""Density clustering per state, as a graph of grid cells.

Cells are small enough that any two points of one cell are neighbours, so cells (not points) are the
nodes. Two cells are linked when some pair of their core points is close enough; bounding boxes
settle most pairs, small ones are compared directly and crowded ones are split in four until they
settle. No step lists all pairs inside a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from talus import vocab
from talus.runtime import cut_lineage, positions

# A graph of at most this many edges is settled with its nodes' smallest neighbours broadcast whole.
SMALL_GRAPH = 100_000
# A node with fewer edges than this is never taken for a hub.
HUB = 16
# A pair of cells with at most this many point pairs is compared point by point.
DIRECT_PAIRS = 4096
_FORWARD = [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3) if (dr, dc) > (0, 0)]
_AROUND = [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3)]


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of every node's component: nodes (node), edges (a, b) -> (node, component).

    Rounds of large stars (every node hands the smallest of its neighbours to the larger ones) and small stars (to the smaller
    ones) until every node points at the smallest of its component. A round is one action, which stores the edges and counts them on the
    way (two for a graph of more than `SMALL_GRAPH` edges). The neighbours of a hub never meet in one task: the smallest of them is
    combined before the shuffle and handed out by broadcast to the rows where they lie.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held, count, mark = _stored_edges(ordered)
    while count:
        both = held.union(held.select(F.col("b"), F.col("a")))
        large = _handed(both.toDF("u", "v"), 2 * count).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct() if count <= SMALL_GRAPH else cut_lineage(large.distinct())
        # An edge between the node and its smallest neighbour is handed to itself and is not needed a second time.
        small = _handed(large.toDF("u", "v"), count)
        turned = small.select(F.col("u").alias("a"), F.col("m").alias("b")).union(
            small.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")))
        held, count, again = _stored_edges(turned)
        if again == mark:
            break
        mark = again
    roots = held.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, F.col("node") == F.col("a"), "left").select("node", F.coalesce("component", "node").alias("component"))


def _stored_edges(edges: DataFrame) -> tuple[DataFrame, int, tuple]:
    """The distinct edges, stored; their number, and a sum of their hashes that tells whether they changed."""
    seen = Observation()
    stored = cut_lineage(edges.distinct().observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")))
    found = seen.get
    return stored, found["n"], (found["n"], found["mark"])


def _handed(pairs: DataFrame, count: int) -> DataFrame:
    """(u, v) with m, the smallest of u and its v. The rows of a node with more than its share of them stay where they are."""
    if count <= SMALL_GRAPH:
        return pairs.join(F.broadcast(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))), "u")
    share = max(HUB, count // (4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > share).select("u", "m"))  # four per partition at most
    rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= share).select("u", "m"), "u")
    return pairs.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _grid(df: DataFrame, side: float) -> DataFrame:
    return df.withColumn("r", F.floor(F.col("latitude") / F.lit(side)).cast("long")).withColumn(
        "c", F.floor(F.col("longitude") / F.lit(side)).cast("long")
    )


def _boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("state", "r", "c").agg(
        F.count("*").alias("rows"),
        F.min("latitude").alias("y0"), F.max("latitude").alias("y1"),
        F.min("longitude").alias("x0"), F.max("longitude").alias("x1"),
    )


def _squared(dy: Column, dx: Column) -> Column:
    return dy * dy + dx * dx


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in pairs]))


def _side(boxes: DataFrame, tag: str) -> DataFrame:
    return boxes.select("state", *[F.col(c).alias(f"{tag}{c}") for c in ("r", "c", "rows", "y0", "y1", "x0", "x1")])


def _linked_cells(core: DataFrame, side: float, eps: float, direct_pairs: int) -> DataFrame:
    """Pairs of cells (state, ar, ac, br, bc) that hold core points no further apart than eps."""
    limit = F.lit(eps)
    boxes = cut_lineage(_boxes(_grid(core, side)))
    pairs = (
        boxes.select("state", F.col("r").alias("ar"), F.col("c").alias("ac"), _offsets(_FORWARD).alias("o"))
        .select("state", "ar", "ac", (F.col("ar") + F.col("o.dr")).alias("br"), (F.col("ac") + F.col("o.dc")).alias("bc"))
    )
    linked: DataFrame | None = None
    level = 0
    while True:
        here = _grid(core, side / (2 ** level))
        both = pairs.join(_side(boxes, "a"), ["state", "ar", "ac"]).join(_side(boxes, "b"), ["state", "br", "bc"])
        gap_y = F.greatest(F.lit(0.0), F.col("ay0") - F.col("by1"), F.col("by0") - F.col("ay1"))
        gap_x = F.greatest(F.lit(0.0), F.col("ax0") - F.col("bx1"), F.col("bx0") - F.col("ax1"))
        far_y = F.greatest(F.col("ay1") - F.col("by0"), F.col("by1") - F.col("ay0"))
        far_x = F.greatest(F.col("ax1") - F.col("bx0"), F.col("bx1") - F.col("ax0"))
        judged = cut_lineage(
            both.where(F.sqrt(_squared(gap_y, gap_x)) <= limit)
            .select("state", "ar", "ac", "br", "bc", (F.sqrt(_squared(far_y, far_x)) <= limit).alias("sure"),
                    (F.col("arows") * F.col("brows") <= direct_pairs).alias("small"))
        )
        points = here.select("state", "r", "c", "latitude", "longitude")
        side_a = points.select("state", F.col("r").alias("ar"), F.col("c").alias("ac"),
                               F.col("latitude").alias("ay"), F.col("longitude").alias("ax"))
        side_b = points.select("state", F.col("r").alias("br"), F.col("c").alias("bc"),
                               F.col("latitude").alias("by"), F.col("longitude").alias("bx"))
        compared = (
            judged.where(~F.col("sure") & F.col("small")).select("state", "ar", "ac", "br", "bc")
            .join(side_a, ["state", "ar", "ac"]).join(side_b, ["state", "br", "bc"])
            .where(F.sqrt(_squared(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))) <= limit)
        )
        up = lambda c: F.shiftright(F.col(c), level).alias(c)
        top = lambda df: df.select("state", up("ar"), up("ac"), up("br"), up("bc"))
        new = top(judged.where("sure")).union(top(compared)).distinct()
        linked = new if linked is None else linked.union(new).distinct()
        open_pairs = judged.where(~F.col("sure") & ~F.col("small"))
        if open_pairs.isEmpty():
            return linked
        linked = cut_lineage(linked)
        tops = ["state", "_tar", "_tac", "_tbr", "_tbc"]
        open_pairs = open_pairs.withColumns({f"_t{k}": F.shiftright(F.col(k), level) for k in ("ar", "ac", "br", "bc")}).join(
            linked.toDF(*tops), tops, "left_anti"
        )
        halves = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        pairs = open_pairs.select("state", "ar", "ac", "br", "bc")
        for name in ("ar", "ac", "br", "bc"):
            pairs = pairs.select(*[x for x in pairs.columns if x != name], halves(name))
        pairs = cut_lineage(pairs)
        level += 1
        boxes = cut_lineage(_boxes(_grid(core, side / (2 ** level))))


def cluster(events: DataFrame, eps_degrees: float = vocab.CLUSTER_EPS_KM / vocab.KM_PER_DEGREE, min_samples: int = 1,
            direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """DBSCAN on (latitude, longitude) degrees inside every state.

    Adds `cluster`: the smallest core id of the event's cluster; a noise event is a cluster of its own.
    A border event joins the lowest-numbered cluster that reaches it.
    """
    side = eps_degrees / math.sqrt(2.0) * (1 - 1e-9)
    places = events.groupBy("state", "latitude", "longitude").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    places = cut_lineage(_grid(places, side))
    if min_samples <= 1:
        core, loose = places, None
    else:
        crowd = places.groupBy("state", "r", "c").agg(F.sum("n").alias("cell_n"))
        marked = places.join(crowd, ["state", "r", "c"])
        sparse = marked.where(F.col("cell_n") < min_samples)
        enough = (
            _meet(sparse, places, eps_degrees).groupBy("state", "latitude", "longitude")
            .agg(F.sum("_n").alias("near")).where(F.col("near") >= min_samples).drop("near")
        )
        place = ["state", "latitude", "longitude"]
        core = cut_lineage(
            marked.where(F.col("cell_n") >= min_samples).select(*places.columns)
            .unionByName(sparse.join(enough, place, "left_semi").select(*places.columns))
        )
        loose = sparse.join(enough, place, "left_anti").select(*places.columns)
    cells = core.groupBy("state", "r", "c").agg(F.min("first_id").alias("node"))
    links = _linked_cells(core.select("state", "latitude", "longitude"), side, eps_degrees, direct_pairs)
    ends = cells.select("state", F.col("r").alias("ar"), F.col("c").alias("ac"), F.col("node").alias("a"))
    other = cells.select("state", F.col("r").alias("br"), F.col("c").alias("bc"), F.col("node").alias("b"))
    edges = links.join(ends, ["state", "ar", "ac"]).join(other, ["state", "br", "bc"]).select("a", "b")
    labels = cells.join(connected_components(cells.select("node"), edges), "node").select("state", "r", "c", "component")
    placed = core.join(labels, ["state", "r", "c"]).select("state", "latitude", "longitude", F.col("component").alias("cluster"))
    if loose is not None:
        near = _meet(loose, core.join(labels, ["state", "r", "c"]), eps_degrees, "component")
        border = near.groupBy("state", "latitude", "longitude").agg(F.min("_component").alias("cluster"))
        placed = placed.unionByName(border)
    joined = events.join(placed, ["state", "latitude", "longitude"], "left")
    return joined.withColumn("cluster", F.coalesce("cluster", "id"))


def _meet(few: DataFrame, many: DataFrame, eps: float, *carry: str) -> DataFrame:
    """Places of `few` (a bounded number per cell) with every place of `many` within eps."""
    seek = few.select("state", "latitude", "longitude", "r", "c", _offsets(_AROUND).alias("o")).select(
        "state", "latitude", "longitude", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")
    )
    target = many.select("state", "r", "c", F.col("latitude").alias("_y"), F.col("longitude").alias("_x"),
                         F.col("n").alias("_n"), *[F.col(x).alias(f"_{x}") for x in carry])
    return seek.join(target, ["state", "r", "c"]).where(
        F.sqrt(_squared(F.col("latitude") - F.col("_y"), F.col("longitude") - F.col("_x"))) <= eps
    )


def _mean(name: str) -> Column:
    """Exact mean to 6 decimals: summed as decimals, so the order of addition cannot show."""
    exact = F.sum(F.col(name).cast("decimal(18,10)")) / F.count("*")
    return F.round(exact, 6).cast("double").alias(name)


def number_clusters(clustered: DataFrame) -> DataFrame:
    """One row per cluster: centroid, size and its number 1..k inside the state, in order of the
    smallest event id."""
    groups = clustered.groupBy("state", "cluster").agg(
        _mean("latitude"), _mean("longitude"), F.count("*").alias("event_count"), F.min("id").alias("first_event"),
    )
    return positions(groups, [F.col("first_event")], ["state"], "cluster_no")
