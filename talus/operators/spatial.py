"""Radius search, radius joins, capped neighbour counts and box queries.

All joins are equi-joins on grid cells followed by an exact distance test. A cell is as tall as the
radius; its width follows the latitude of its row, so a point touches a handful of cells anywhere
between the poles. Points next to the date line also look on its other side.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus import vocab
from talus.functions import geo
from talus.operators import circle_counts
from talus.runtime import BROADCAST_ROW_LIMIT, SPREAD_TASKS, broadcast_if_small, cut_lineage

# Cells with more distinct target rows than this are subdivided instead of compared row by row.
DENSE_ROWS = 2048
# Dated circles are counted in tasks where cells hold this many rows on average; a cell with more than TASK_ROWS is subdivided.
FILLED_ROWS = 256
TASK_ROWS = 131_072
# Cells with more distinct places than this are split in four by the k-nearest search.
LEAF_ROWS = 64
# Length of the periods that whole cells are added up by.
PERIOD_DAYS = 32
# Points that share their places at least this often (on average) are counted place by place ...
SHARED_PLACE = 4
# ... as long as places times instants is at most this many times the rows that are read.
TIMELINE_ROWS = 64


def _row_width(row: Column, size: float) -> Column:
    worst = F.greatest(F.abs(row * F.lit(size)), F.abs((row + 1) * F.lit(size)))
    return F.lit(size) / F.greatest(F.cos(F.radians(F.least(worst, F.lit(90.0)))), F.lit(0.01))


def target_cells(df: DataFrame, size: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The one grid cell each target lies in."""
    return df.withColumn("_row", geo.cell(F.col(lat), size)).withColumn(
        "_col", F.floor(F.col(lon) / _row_width(F.col("_row"), size)).cast("long")
    )


def search_cells(df: DataFrame, radius_km: float, size: float,
                 lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Every grid cell a point's search circle can reach, one output row per cell."""
    half_lat = F.lit(radius_km * geo.BOX_SLACK / vocab.KM_PER_DEGREE)
    edge = F.abs(F.col(lat)) + half_lat
    half_lon = F.when(edge >= 89.4, F.lit(180.0)).otherwise(
        F.least(F.lit(180.0), half_lat / F.greatest(F.cos(F.radians(edge)), F.lit(0.01)))
    )
    shifts = F.array_compact(
        F.array(
            F.col(lon),
            F.when(F.col(lon) - F.col("_half") < -180.0, F.col(lon) + 360.0),
            F.when(F.col(lon) + F.col("_half") > 180.0, F.col(lon) - 360.0),
        )
    )
    width = _row_width(F.col("_row"), size)
    columns = F.sequence(
        F.floor((F.col("_x") - F.col("_half")) / width).cast("long"),
        F.floor((F.col("_x") + F.col("_half")) / width).cast("long"),
    )
    return (
        df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .withColumn("_half", half_lon)
        .withColumn("_x", F.explode(shifts))
        .withColumn("_row", F.explode(geo.cells_covering(F.col(lat), half_lat, size)))
        .withColumn("_col", F.explode(columns))
        .drop("_half", "_x")
    )


def in_held_cells(seekers: DataFrame, targets: DataFrame, key: list[str], limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """The rows of `seekers` whose cell holds a target, while the cells that do are few enough to be broadcast; else all of them.
    The others would be shuffled to meet nobody."""
    held = cut_lineage(targets.select(*key).distinct().limit(limit + 1))
    return seekers if held.count() > limit else seekers.join(F.broadcast(held), key, "left_semi")


def radius_pairs(points: DataFrame, targets: DataFrame, radius_km: float) -> DataFrame:
    """All (point, target) pairs within the radius, with `distance_km`.

    Both inputs carry latitude and longitude; every other column must be named differently on the
    two sides. Target coordinates come out as target_latitude and target_longitude.
    """
    size = geo.cell_size_degrees(radius_km)
    near = target_cells(targets, size).withColumnsRenamed(
        {"latitude": "target_latitude", "longitude": "target_longitude"}
    )
    reach = search_cells(points, radius_km, size)
    distance = geo.haversine_km(
        F.col("latitude"), F.col("longitude"), F.col("target_latitude"), F.col("target_longitude")
    )
    return (
        reach.join(near, ["_row", "_col"])
        .drop("_row", "_col")
        .withColumn("distance_km", distance)
        .where(F.col("distance_km") <= radius_km)
    )


def k_nearest(points: DataFrame, targets: DataFrame, k: int, radius_km: float, tie: str = "id", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Up to `k` nearest targets within the radius (a few hundred km at most) of every point, ties to the smaller `tie` column.

    `points` has point_id, latitude, longitude; `targets` latitude, longitude and a unique `tie`. Returns (point_id, rank, `tie`,
    distance_km); points without a target in reach have no row.

    The search runs once per place, whatever number of points share it; points meet only the short list of their place.

    Of the targets of one place only the first `k` can matter, so copies are cut before any join. Points meet cells, not
    targets: of the cells a point can reach, those whose nearest corner lies beyond a distance that is sure to hold `k` targets
    already are dropped, and of the others the crowded ones are split in four and judged again. Only the targets of the small cells that
    remain are compared, and every task keeps `k` of a point before the shuffle.
    """
    size = geo.cell_size_degrees(radius_km)
    key = ["_row", "_col"]
    first = Window.partitionBy("latitude", "longitude").orderBy(tie)
    places = (
        targets.select(F.col(tie).alias("_tie"), "latitude", "longitude", F.row_number().over(first).alias("_place"))
        .where((F.col("_place") <= k) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).drop("_place")
    )
    rows = cut_lineage(target_cells(places, size))
    placed = points.select("point_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).where("_lat IS NOT NULL AND _lon IS NOT NULL")
    # Places are few bytes each, but every one makes many rows.
    asking = cut_lineage(placed.select("_lat", "_lon").distinct().repartition(SPREAD_TASKS * points.sparkSession.sparkContext.defaultParallelism))
    met = _meet_cells(search_cells(asking, radius_km, size, "_lat", "_lon"), rows, key, radius_km)
    settled: list[DataFrame] = []
    level = 0
    while True:
        kept = cut_lineage(_within_reach(met, k, radius_km, key))
        crowded = (F.col("_n") > leaf_rows) & (F.col("_level") == level) & ~F.col("_single")
        here = kept.where((F.col("_level") == level) & ~crowded)
        settled.append(here.select("_lat", "_lon", *key).join(rows, key))
        wide = kept.where(crowded)
        if wide.isEmpty():
            break
        # The cells of a place that are split are looked at again together with those that are not: both count for its reach.
        rows = rows.join(broadcast_if_small(wide.select(*key).distinct()), key, "left_semi")
        level += 1
        step = size / (2 ** level)
        base = F.shiftright(F.col("_row"), level)
        rows = cut_lineage(rows.withColumn("_row", geo.cell(F.col("latitude"), step)).withColumn(
            "_col", F.floor(F.col("longitude") / (_row_width(base, size) / F.lit(float(2 ** level)))).cast("long")))
        halves = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
        seekers = wide.select("_lat", "_lon", halves("_row").alias("_row"), "_col").withColumn("_col", halves("_col"))
        met = _meet_cells(seekers, rows, key, radius_km, level).unionByName(kept.where(~crowded))
    distance = geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
    pairs = reduce(DataFrame.unionByName, [s.select("_lat", "_lon", "_tie", "latitude", "longitude") for s in settled])
    best = lambda *by: Window.partitionBy(*by).orderBy("distance_km", "_tie")
    listed = cut_lineage(
        pairs.withColumn("distance_km", distance).where(F.col("distance_km") <= radius_km)
        .withColumn("rank", F.row_number().over(best("_lat", "_lon"))).where(F.col("rank") <= k)
        .groupBy("_lat", "_lon").agg(F.sort_array(F.collect_list(F.struct("distance_km", "_tie"))).alias("_near"))
    )
    # Rows of one point are brought together once, for the distinct rows and for the ranks.
    return (
        placed.repartition("point_id").distinct().join(broadcast_if_small(listed, BROADCAST_ROW_LIMIT // k), ["_lat", "_lon"])
        .select("point_id", F.inline("_near"))
        .withColumn("rank", F.row_number().over(best("point_id"))).where(F.col("rank") <= k)
        .select("point_id", "rank", F.col("_tie").alias(tie), "distance_km")
    )


def _meet_cells(seekers: DataFrame, rows: DataFrame, key: list[str], radius_km: float, level: int = 0) -> DataFrame:
    """Places with the cells of `rows` they look into: number of targets, bounds of their distances, level."""
    cells = rows.groupBy(*key).agg(
        F.count("*").alias("_n"), F.min("latitude").alias("_lat0"), F.max("latitude").alias("_lat1"),
        F.min("longitude").alias("_lon0"), F.max("longitude").alias("_lon1"))
    low, high = _box_distances(F.col("_lat"), F.col("_lon"))
    single = (F.col("_lat0") == F.col("_lat1")) & (F.col("_lon0") == F.col("_lon1"))
    return (
        seekers.join(broadcast_if_small(cells), key).withColumns({"_low": low, "_high": high, "_single": single, "_level": F.lit(level)})
        .where(F.col("_low") <= radius_km).select("_lat", "_lon", *key, "_n", "_low", "_high", "_single", "_level")
    )


def _within_reach(met: DataFrame, k: int, radius_km: float, key: list[str]) -> DataFrame:
    """The cells of every place that may hold one of its `k` nearest targets. The reach is the least upper bound up to which the
    cells hold `k` targets; at most `k` cells lie wholly inside it, so the list per place is short."""
    fields = ["_high", "_low", "_n", *key, "_single", "_level"]
    lists = met.groupBy("_lat", "_lon").agg(F.sort_array(F.collect_set(F.struct(*fields))).alias("_cells"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float(radius_km)).alias("reach"))
    reach = F.aggregate("_cells", none, lambda acc, c: F.struct(
        (acc["n"] + c["_n"]).alias("n"),
        F.when((acc["n"] < k) & (acc["n"] + c["_n"] >= k), F.least(acc["reach"], c["_high"])).otherwise(acc["reach"]).alias("reach")))
    lists = lists.withColumn("_reach", reach["reach"])
    kept = F.filter("_cells", lambda c: c["_low"] <= F.col("_reach"))
    return lists.select("_lat", "_lon", F.inline(kept))


def common_filters(df: DataFrame, date: str, source_id: str | None = None, start=None, end=None) -> DataFrame:
    """Optional source and date filters; a date filter drops rows without a date."""
    if source_id:
        df = df.where(F.col("source_id") == source_id)
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("timestamp_ntz"))
    return df


def nearby(df: DataFrame, lat: float, lon: float, radius_km: float, limit: int, date: str, tie: list[str],
           **filters) -> DataFrame:
    """Rows within the radius of one place, nearest first."""
    boxed = df.where(geo.circle_box(F.col("latitude"), F.col("longitude"), lat, lon, radius_km))
    distance = geo.haversine_km(F.lit(float(lat)), F.lit(float(lon)), F.col("latitude"), F.col("longitude"))
    return (
        common_filters(boxed, date, **filters)
        .withColumn("_distance", distance)
        .where(F.col("_distance") <= radius_km)
        .orderBy("_distance", *tie)
        .limit(limit)
        .withColumn("distance_km", F.round("_distance", 3))
        .drop("_distance")
    )


def in_box(df: DataFrame, box: tuple[float, float, float, float], limit: int, date: str, tie: list[str],
           **filters) -> DataFrame:
    """Newest rows in a box plus how many match and whether the list was cut."""
    inside = common_filters(df.where(geo.within_box(F.col("latitude"), F.col("longitude"), *box)), date, **filters)
    total = inside.agg(F.count("*").alias("total_matching"))
    page = inside.orderBy(F.col(date).desc_nulls_last(), *tie).limit(limit)
    return page.withColumn("total_matching", total.scalar()).withColumn("truncated", F.col("total_matching") > limit)


def _box_distances(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Lower and upper bound of the distance from a point to a cell's bounding box, seen from the box's own side of the date
    line."""
    lon = lon + 360.0 * F.round(((F.col("_lon0") + F.col("_lon1")) / 2 - lon) / 360.0)
    close_lat = F.greatest(F.col("_lat0"), F.least(lat, F.col("_lat1")))
    close_lon = F.greatest(F.col("_lon0"), F.least(lon, F.col("_lon1")))
    corners = [
        geo.haversine_km(lat, lon, F.col(a), F.col(b)) for a in ("_lat0", "_lat1") for b in ("_lon0", "_lon1")
    ]
    single = (F.col("_lat0") == F.col("_lat1")) & (F.col("_lon0") == F.col("_lon1"))
    exact = corners[0]
    low = F.when(single, exact).otherwise(geo.haversine_km(lat, lon, close_lat, close_lon) * 0.998)
    high = F.when(single, exact).otherwise(F.greatest(*corners) * 1.002)
    return low, high


def count_within(points: DataFrame, targets: DataFrame, radius_km: float, cap: int | None = None,
                 dense_rows: int = DENSE_ROWS, filled_rows: int = FILLED_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Number of targets within the radius and not later than the point's as_of (no more than `cap`, if given).

    `points` has point_id, latitude, longitude and (optionally) as_of; `targets` has latitude,
    longitude and, when as_of is used, `ts`. Only points with at least one hit appear in the result
    (point_id, hits).

    Copies of a place and time are counted before any join. Where dated cells are well filled, a task counts the points of a cell
    against the rows around it (circle_counts); what follows holds elsewhere. Sparse cells are compared row by row.
    Dense cells are never compared pairwise: a cell wholly inside the circle contributes the totals of
    the periods before the point's own and the rows of its last day, a cell wholly outside nothing, and only cells the circle cuts through
    are split in four and looked at again, down to single places.

    Where many dated points stand in few places, the circle is drawn once per place: its targets are added up per instant, and a point
    looks its count up in the running total of its place.
    """
    timed = "as_of" in points.columns
    keep = ["latitude", "longitude"] + (["ts"] if timed else [])
    rows = targets.select(*keep).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if timed:
        rows = rows.where(F.col("ts").isNotNull())
    size = geo.cell_size_degrees(radius_km)
    hits = F.sum("hits") if cap is None else F.least(F.sum("hits"), F.lit(cap))
    counted = None
    if timed and radius_km >= 0.01:
        held = rows.groupBy(*keep).agg(F.count("*").alias("_n"))
        cells = target_cells(held, size).groupBy("_row", "_col").agg(F.count("*").alias("_rows"))
        seen = cells.agg(F.count("*").alias("cells"), F.sum("_rows").alias("rows"), F.max("_rows").alias("most")).first()
        if seen["cells"] and seen["rows"] >= filled_rows * seen["cells"]:
            if seen["most"] > task_rows:
                crowded = broadcast_if_small(cut_lineage(cells.where(F.col("_rows") > task_rows).drop("_rows")))
                held = target_cells(held, size).join(crowded, ["_row", "_col"], "left_anti").drop("_row", "_col")
                rows = target_cells(rows, size).join(crowded, ["_row", "_col"], "left_semi").drop("_row", "_col")
            counted = circle_counts.count_dated(
                points, held, lambda df: target_cells(df, size), lambda df: search_cells(df, radius_km, size),
                points.schema["point_id"].dataType.simpleString(), radius_km)
            if seen["most"] <= task_rows:
                return counted.groupBy("point_id").agg(hits.cast("long").alias("hits"))
    by_place = timed and _places_are_shared(points, rows)
    rows = target_cells(rows.groupBy(*keep).agg(F.count("*").alias("_n")), size)
    if by_place:
        # The places are few and often broadcast, so the tasks are those of the rows; a cell's rows stay together and are added up early.
        rows = rows.repartition(4 * points.sparkSession.sparkContext.defaultParallelism, "_row", "_col")
    seekers = points.select("latitude", "longitude").distinct() if by_place else points.select(
        "point_id", *(["as_of"] if timed else []), "latitude", "longitude")
    key = ["_row", "_col"]
    seekers = in_held_cells(search_cells(seekers, radius_km, size), rows, key)
    found: list[DataFrame] = []
    level = 0
    while True:
        cells = rows.groupBy(*key).agg(F.count("*").alias("_rows"))
        dense = cells.where(F.col("_rows") > dense_rows).drop("_rows")
        if dense.isEmpty():
            found.append(_compare_rows(seekers, rows, key, radius_km, timed))
            break
        dense = broadcast_if_small(cut_lineage(dense))
        found.append(_compare_rows(seekers, rows.join(dense, key, "left_anti"), key, radius_km, timed))
        rows = rows.join(dense, key, "left_semi")
        boxes = rows.groupBy(*key).agg(
            F.min("latitude").alias("_lat0"), F.max("latitude").alias("_lat1"),
            F.min("longitude").alias("_lon0"), F.max("longitude").alias("_lon1"),
        )
        low, high = _box_distances(F.col("latitude"), F.col("longitude"))
        met = cut_lineage(
            seekers.join(broadcast_if_small(boxes), key)
            .withColumn("_low", low).withColumn("_high", high)
            .where(F.col("_low") <= radius_km)
            .drop("_lat0", "_lat1", "_lon0", "_lon1")
        )
        found.append(_count_whole_cells(met.where(F.col("_high") <= radius_km), rows, key, timed))
        cut = met.where(F.col("_high") > radius_km).drop("_low", "_high")
        if cut.isEmpty():
            break
        # Only cells some circle cuts through are looked at again; a single place never is.
        rows = rows.join(broadcast_if_small(cut.select(*key).distinct()), key, "left_semi")
        level += 1
        step = size / (2 ** level)
        base = F.shiftright(F.col("_row"), level)
        rows = rows.withColumn("_row", geo.cell(F.col("latitude"), step)).withColumn(
            "_col", F.floor(F.col("longitude") / (_row_width(base, size) / F.lit(float(2 ** level)))).cast("long")
        )
        rows = cut_lineage(rows)
        seekers = (
            cut
            .withColumn("_row", F.explode(F.array(F.col("_row") * 2, F.col("_row") * 2 + 1)))
            .withColumn("_col", F.explode(F.array(F.col("_col") * 2, F.col("_col") * 2 + 1)))
        )
    total = reduce(DataFrame.unionByName, found)
    if by_place:
        total = _look_up(points, total)
    if counted is not None:
        total = total.unionByName(counted)
    return total.groupBy("point_id").agg(hits.cast("long").alias("hits")).where("hits > 0")


def _places_are_shared(points: DataFrame, rows: DataFrame) -> bool:
    """Do the points stand in so few places that a running total per place stays in proportion to the rows?"""
    place = F.xxhash64("latitude", "longitude")
    seen = points.agg(F.count("*").alias("n"), F.approx_count_distinct(place).alias("places")).first()
    times = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("ts").alias("instants")).first()
    return seen["places"] * SHARED_PLACE <= seen["n"] and seen["places"] * times["instants"] <= TIMELINE_ROWS * (seen["n"] + times["n"])


def _look_up(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Hits of dated points from the targets around every place, added up per instant."""
    place = ["latitude", "longitude"]
    dated = points.where(F.col("as_of").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    asked = dated.select(*place, F.col("as_of").alias("at")).distinct()
    added = parts.groupBy(*place, F.col("ts").alias("at")).agg(F.sum("hits").alias("hits"))
    both = added.withColumn("_asks", F.lit(0)).unionByName(asked.withColumns({"hits": F.lit(0).cast("long"), "_asks": F.lit(1)}))
    # A target of the point's own instant counts, so the question comes after it.
    so_far = Window.partitionBy(*place).orderBy("at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    answers = both.withColumn("hits", F.sum("hits").over(so_far)).where((F.col("_asks") == 1) & (F.col("hits") > 0)).drop("_asks")
    return dated.select("point_id", *place, F.col("as_of").alias("at")).join(answers, [*place, "at"]).select("point_id", "hits")


def _on_sphere(df: DataFrame, prefix: str, lat: str, lon: str) -> DataFrame:
    flat = F.cos(F.radians(lat))
    return df.withColumns({
        f"{prefix}x": flat * F.cos(F.radians(lon)), f"{prefix}y": flat * F.sin(F.radians(lon)), f"{prefix}z": F.sin(F.radians(lat)),
    })


def _compare_rows(seekers: DataFrame, rows: DataFrame, key: list[str], radius_km: float, timed: bool) -> DataFrame:
    """Pairwise test inside cells. The straight-line distance settles all but the pairs within a
    millionth of the radius, which are few; only those need the full formula."""
    near = _on_sphere(rows, "_t", "latitude", "longitude").withColumnsRenamed({"latitude": "_tlat", "longitude": "_tlon"})
    pairs = _on_sphere(seekers, "_p", "latitude", "longitude").join(near, key)
    by_place = timed and "as_of" not in seekers.columns
    if timed and not by_place:
        pairs = pairs.where(F.col("ts") <= F.col("as_of"))
    chord = None
    for axis in "xyz":
        step = (F.col(f"_p{axis}") - F.col(f"_t{axis}")) * (F.col(f"_p{axis}") - F.col(f"_t{axis}"))
        chord = step if chord is None else chord + step
    limit = (2 * math.sin(radius_km / vocab.EARTH_RADIUS_KM / 2)) ** 2
    exact = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_tlat"), F.col("_tlon")) <= radius_km
    margin = 1e-6 if radius_km >= 0.01 else 1.0
    pairs = pairs.where((chord <= limit * (1 - margin)) | ((chord <= limit * (1 + margin)) & exact))
    return pairs.groupBy(*(["latitude", "longitude", "ts"] if by_place else ["point_id"])).agg(F.sum("_n").alias("hits"))


def _count_whole_cells(pairs: DataFrame, rows: DataFrame, key: list[str], timed: bool) -> DataFrame:
    """Exact counts of whole cells. Times are added up per period of `PERIOD_DAYS` days and per day: a cell holds one
    total per period, a period of a cell one per day, so both lists are bounded by the calendar, and only the point's own
    day is counted by its distinct times."""
    if not timed:
        totals = rows.groupBy(*key).agg(F.sum("_n").alias("_cell"))
        return pairs.join(totals, key).groupBy("point_id").agg(F.sum("_cell").alias("hits"))
    if "as_of" not in pairs.columns:
        instants = rows.groupBy(*key, "ts").agg(F.sum("_n").alias("_cell"))
        return pairs.select("latitude", "longitude", *key).join(instants, key).groupBy("latitude", "longitude", "ts").agg(F.sum("_cell").alias("hits"))
    day = lambda c: F.unix_date(F.to_date(c))
    period = lambda c: F.floor(day(c) / PERIOD_DAYS)
    times = rows.groupBy(*key, "ts").agg(F.sum("_n").alias("_n")).withColumns({"_day": day("ts"), "_period": period("ts")})
    days = times.groupBy(*key, "_period", "_day").agg(F.sum("_n").alias("_n"))
    in_period = days.groupBy(*key, "_period").agg(F.collect_list(F.struct(F.col("_day").alias("at"), "_n")).alias("_list"), F.sum("_n").alias("_n"))
    in_cell = in_period.groupBy(*key).agg(F.collect_list(F.struct(F.col("_period").alias("at"), "_n")).alias("_list"))
    own = pairs.select("point_id", "as_of", *key, day("as_of").alias("_day"), period("as_of").alias("_period"))
    before = lambda name: F.aggregate(
        F.filter("_list", lambda t: t["at"] < F.col(name)), F.lit(0).cast("long"), lambda acc, t: acc + t["_n"])
    parts = [
        own.join(in_cell, key).select("point_id", before("_period").alias("_cell")),
        own.join(in_period.drop("_n"), [*key, "_period"]).select("point_id", before("_day").alias("_cell")),
        own.join(times.drop("_period"), [*key, "_day"]).where(F.col("ts") <= F.col("as_of")).select("point_id", F.col("_n").alias("_cell")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("point_id").agg(F.sum("_cell").alias("hits"))


def with_nearby(points: DataFrame, targets: DataFrame, radius_km: float, name: str) -> DataFrame:
    """Adds whether any target lies within the radius, whatever its date. A target is sent to all cells its circle reaches, a point stays
    in its own and ends at the first target it meets: the points are shuffled once, or not at all while the targets are few."""
    size = geo.cell_size_degrees(radius_km)
    places = search_cells(targets.select("latitude", "longitude").distinct(), radius_km, size)
    near = _on_sphere(places, "_t", "latitude", "longitude").withColumnsRenamed(
        {"_row": "_trow", "_col": "_tcol", "latitude": "_tlat", "longitude": "_tlon"})
    sought = _on_sphere(target_cells(points, size), "_p", "latitude", "longitude")
    # The straight-line distance settles all but the pairs close to the radius, as in _compare_rows.
    chord = " + ".join(f"(p._p{a} - t._t{a}) * (p._p{a} - t._t{a})" for a in "xyz")
    limit, margin = (2 * math.sin(radius_km / vocab.EARTH_RADIUS_KM / 2)) ** 2, 1e-6 if radius_km >= 0.01 else 1.0
    part = "pow(sin(radians(t._tlat - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(t._tlat)) * pow(sin(radians(t._tlon - p.longitude) / 2), 2)"
    exact = f"{2 * vocab.EARTH_RADIUS_KM!r}D * atan2(sqrt(least(1D, {part})), sqrt(1D - least(1D, {part}))) <= {float(radius_km)!r}D"
    # An EXISTS of SQL becomes one existence join; the method of the same name loses its condition here.
    return points.sparkSession.sql(
        f"""SELECT p.*, EXISTS (SELECT 1 FROM {{near}} t WHERE t._trow = p._row AND t._tcol = p._col AND {chord} <= {limit * (1 + margin)!r}D
            AND ({chord} <= {limit * (1 - margin)!r}D OR {exact})) AS `{name}` FROM {{sought}} p""",
        near=broadcast_if_small(near), sought=sought).drop("_row", "_col", "_px", "_py", "_pz")


def outside_buffer(points: DataFrame, events: DataFrame, buffer_km: float = vocab.BUFFER_KM) -> DataFrame:
    """Points with no event at all within the buffer, whatever its date."""
    bare = points.drop("as_of") if "as_of" in points.columns else points
    hit = count_within(bare, events, buffer_km, cap=1)
    return points.join(hit.select("point_id"), "point_id", "left_anti")


def event_density(points: DataFrame, events: DataFrame, radius_km: float = vocab.DENSITY_RADIUS_KM,
                  cap: int | None = None, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """Past events around every point: exact count (a `cap` limits it, if given) and count per square kilometre; 0 is kept."""
    hits = count_within(points, events.withColumnRenamed("event_date", "ts"), radius_km, cap, dense_rows)
    count = F.coalesce(F.col("hits"), F.lit(0).cast("long"))
    return points.join(hits, "point_id", "left").select(
        *points.columns,
        count.alias("historical_landslide_count"),
        geo.density_per_km2(count, radius_km).alias(vocab.DENSITY_FEATURE),
    )
