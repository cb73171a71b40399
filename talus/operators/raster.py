"""Raster bands as cell tables: metadata, sampling, 3x3 neighbourhoods, mosaics.

cells: (tile_lat, tile_lon, row, col, value); tiles: one row per tile with left, top, res_x, res_y,
width, height, nodata, geographic. All tiles of a raster span the same number of whole `degrees` (one unless said
otherwise) and the same pixel grid, so a point knows its tile by flooring, and a pixel its neighbours in the next tile.
There are at most 64,800 tiles on Earth: a set of tiles is always small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import geo, terrain
from talus.runtime import attach_to_groups, broadcast_if_small, stored

TILE = ["tile_lat", "tile_lon"]
PIXEL = ["tile_lat", "tile_lon", "row", "col"]
OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
# Rows and columns of the patches that a whole tile is cut into.
PATCH = 64


def summarize(cells: DataFrame, res: float, nodata: float | None, geographic: bool = True,
              crs: str = "EPSG:4326", degrees: int = 1) -> DataFrame:
    """Metadata of every tile, read off its cells."""
    return cells.groupBy(*TILE).agg(
        (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height")
    ).select(
        *TILE,
        F.col("tile_lon").cast("double").alias("left"),
        (F.col("tile_lat") + degrees).cast("double").alias("top"),
        F.lit(res).alias("res_x"), F.lit(res).alias("res_y"), "width", "height",
        F.lit(nodata).cast("double").alias("nodata"), F.lit(geographic).alias("geographic"), F.lit(crs).alias("crs"),
    )


def bounds(tiles: DataFrame) -> DataFrame:
    return tiles.withColumns({
        "right": F.col("left") + F.col("width") * F.col("res_x"),
        "bottom": F.col("top") - F.col("height") * F.col("res_y"),
    })


def to_pixels(points: DataFrame, tiles: DataFrame, degrees: int = 1) -> DataFrame:
    """Adds tile, row, col and tile metadata; `covered` is false outside every tile."""
    tile_lat, tile_lon = [(F.floor(F.col(c) / float(degrees)) * degrees).cast("int") for c in ("latitude", "longitude")]
    placed = points.withColumn("tile_lat", tile_lat).withColumn("tile_lon", tile_lon).join(
        broadcast_if_small(tiles), TILE, "left"
    )
    row, col = geo.pixel(F.col("latitude"), F.col("longitude"), F.col("top"), F.col("left"), F.col("res_x"), F.col("res_y"))
    placed = placed.withColumn("row", row).withColumn("col", col)
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width"))
    return placed.withColumn("covered", F.coalesce(inside, F.lit(False)))


_META = ["left", "top", "res_x", "res_y", "width", "height", "nodata", "geographic", "crs", "covered", *PIXEL]


def needed(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """The cells of the tiles that some pixel lies in; on a table partitioned by tile, only those are read."""
    return cells.join(F.broadcast(pixels.select(*TILE).distinct()), TILE, "left_semi")


def sample(points: DataFrame, cells: DataFrame, tiles: DataFrame, name: str = "value", degrees: int = 1) -> DataFrame:
    """Cell value under each point; NULL outside the raster and on nodata."""
    placed = to_pixels(points, tiles, degrees)
    out = placed.join(needed(cells, placed.where("covered")), PIXEL, "left")
    valid = F.col("covered") & (F.col("nodata").isNull() | (F.col("value") != F.col("nodata")))
    return out.withColumn(f"_{name}", F.when(valid, F.col("value"))).drop(*_META, "value").withColumnRenamed(f"_{name}", name)


def landcover(points: DataFrame, cells: DataFrame, tiles: DataFrame, scheme: str | None = "esa_worldcover",
              degrees: int = 1) -> DataFrame:
    """Raw class, category and availability under each point."""
    out = sample(points, cells, tiles, "_code", degrees)
    seen = F.col("_code").isNotNull()
    return out.select(
        *points.columns,
        F.col("_code").cast("int").alias("raw_class"),
        F.when(seen, terrain.landcover_category(F.col("_code"), scheme)).alias("landcover_category"),
        seen.alias("landcover_available"),
    )


def neighbourhoods(pixels: DataFrame, cells: DataFrame, across: bool = True, degrees: int = 1) -> DataFrame:
    """The 3x3 block of every distinct pixel: nine columns and how many of them exist. With `across`, a block reaches over
    the seams into the next tiles, as on one mosaic; without, it ends at its own tile.

    Distinct pixels are looked up once however many points share them; the nine cells of a block meet
    again in one aggregation on the pixel.
    """
    shift = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in OFFSETS]))
    across = across and {"height", "width"} <= set(pixels.columns)  # without tile sizes there are no seams to cross
    if pixels is cells and not across:
        return _every_block(cells)
    wanted = pixels.select(*PIXEL, *(["height", "width"] if across else [])).distinct().withColumn("o", shift)
    row, col = F.col("row") + F.col("o.dr"), F.col("col") + F.col("o.dc")
    down, right = (F.floor(row / F.col("height")), F.floor(col / F.col("width"))) if across else (F.lit(0), F.lit(0))
    wanted = wanted.select(
        (F.col("tile_lat") - down * degrees).cast("int").alias("tile_lat"), (F.col("tile_lon") + right * degrees).cast("int").alias("tile_lon"),
        F.col("tile_lat").alias("_tile_lat"), F.col("tile_lon").alias("_tile_lon"), F.col("row").alias("_row"), F.col("col").alias("_col"), "o",
        (row - down * F.col("height") if across else row).cast("int").alias("row"),
        (col - right * F.col("width") if across else col).cast("int").alias("col"),
    )
    at = lambda dr, dc: (F.col("o.dr") == dr) & (F.col("o.dc") == dc)
    return (
        wanted.join(needed(cells, wanted), PIXEL)
        .groupBy(*[F.col(f"_{c}").alias(c) for c in PIXEL])
        .agg(*[F.max(F.when(at(dr, dc), F.col("value"))).alias(_cell(dr, dc)) for dr, dc in OFFSETS], F.count("*").alias("n"))
    )


def _every_block(cells: DataFrame) -> DataFrame:
    """The 3x3 block of every pixel that has a cell, within its tile. Tiles are cut into patches, and a cell is shuffled once to
    its patch (on the edge of one, to the next patch, too); its value meets the nine blocks it belongs to there."""
    patch = lambda c: F.floor(c / F.lit(PATCH))
    around = lambda c: F.explode(F.array_distinct(F.array(patch(F.col(c) - 1), patch(F.col(c) + 1))))
    key = [*TILE, "_prow", "_pcol"]
    spark = cells.sparkSession
    # A task's blocks take far more room than its cells: many small tasks, which are not put together again.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    placed = (
        cells.select(*PIXEL, "value").dropna(subset=PIXEL)
        .withColumn("_prow", around("row")).withColumn("_pcol", around("col")).repartition(tasks, *key)
    )
    shift = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in OFFSETS]))
    at = lambda dr, dc: (F.col("o.dr") == dr) & (F.col("o.dc") == dc)
    met = (
        placed.withColumn("o", shift)
        .withColumns({"row": F.col("row") - F.col("o.dr"), "col": F.col("col") - F.col("o.dc")})
        .where((patch(F.col("row")) == F.col("_prow")) & (patch(F.col("col")) == F.col("_pcol")))
    )
    return (
        met.groupBy(*key, "row", "col")
        .agg(*[F.max(F.when(at(dr, dc), F.col("value"))).alias(_cell(dr, dc)) for dr, dc in OFFSETS], F.count("*").alias("n"),
             F.count(F.when(at(0, 0), F.lit(1))).alias("_own"))
        .where("_own > 0").select(*PIXEL, *[_cell(*o) for o in OFFSETS], "n")
    )


def _cell(dr: int, dc: int) -> str:
    return f"z{dr + 1}{dc + 1}"


def terrain_features(points: DataFrame, cells: DataFrame, tiles: DataFrame, across: bool = True, degrees: int = 1,
                     store: bool = False) -> DataFrame:
    """Elevation, slope and aspect under each point.

    Nodata is tested on the centre only. A pixel on the raster's edge (without `across`: on its tile's edge) has an
    elevation but no slope. With `store`, the blocks are stored first: one row per distinct pixel, often far fewer than the points,
    which are then not shuffled.
    """
    placed = to_pixels(points, tiles, degrees)
    blocks = neighbourhoods(placed.where("covered"), cells, across, degrees)
    if store:
        blocks = broadcast_if_small(stored(blocks, "blocks"))
    joined = attach_to_groups(placed, blocks, PIXEL)
    centre = F.col(_cell(0, 0))
    valid = F.col("covered") & centre.isNotNull() & (F.col("nodata").isNull() | (centre != F.col("nodata")))
    size_x, size_y = terrain.cell_metres(F.col("res_x"), F.col("res_y"), F.col("latitude"), F.col("geographic"))
    slope, aspect = terrain.horn({o: F.col(_cell(*o)) for o in OFFSETS if o != (0, 0)}, size_x, size_y)
    full = valid & (F.col("n") == 9)
    return joined.select(
        *points.columns,
        F.when(valid, F.round(centre, 2)).alias("elevation_m"),
        F.when(full, slope).alias("slope_degrees"),
        F.when(full, aspect).alias("aspect_degrees"),
        F.coalesce(valid, F.lit(False)).alias("terrain_available"),
    )


def fill_zone_terrain(zones: DataFrame, cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Derived zones still without terrain take it from their own tile; an edge cell counts as flat."""
    waiting = zones.where((F.col("source_type") == "derived") & ~F.col("terrain_data_real"))
    seen = terrain_features(waiting, cells, tiles, across=False)
    got = F.col("terrain_available")
    return seen.select(
        *[c for c in zones.columns if c not in ("elevation", "slope", "terrain_data_real")],
        F.when(got, F.col("elevation_m")).otherwise(F.col("elevation")).alias("elevation"),
        F.when(got, F.coalesce("slope_degrees", F.lit(0.0))).otherwise(F.col("slope")).alias("slope"),
        (F.col("terrain_data_real") | got).alias("terrain_data_real"),
    )


def mosaic(layers: list[tuple[DataFrame, float | None]]) -> DataFrame:
    """Overlay of rasters on one global grid (row, col, value): the first layer with data wins."""
    stacked = None
    for order, (cells, nodata) in enumerate(layers):
        value = F.col("value")
        usable = cells if nodata is None else cells.where(value != nodata)
        part = usable.select("row", "col", F.lit(order).alias("_order"), value)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("row", "col").agg(F.min_by("value", "_order").alias("value"))


def tiles_for_points(points: DataFrame) -> DataFrame:
    """Distinct one-degree elevation tiles and three-degree land-cover tiles the points need."""
    a, b = geo.one_degree_tile(F.col("latitude"), F.col("longitude"))
    c, d = geo.three_degree_tile(F.col("latitude"), F.col("longitude"))
    return points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        a.alias("dem_lat"), b.alias("dem_lon"), c.alias("landcover_lat"), d.alias("landcover_lon")
    ).distinct()


def tiles_for_boxes(boxes: DataFrame, degrees: int) -> DataFrame:
    """Every tile a box (min_lat, min_lon, max_lat, max_lon) touches."""
    def span(low: str, high: str) -> Column:
        snap = lambda c: (F.floor(F.col(c) / float(degrees)) * degrees).cast("int")
        return F.sequence(snap(low), snap(high), F.lit(degrees))

    return boxes.withColumn("tile_lat", F.explode(span("min_lat", "max_lat"))).withColumn(
        "tile_lon", F.explode(span("min_lon", "max_lon"))
    )


def terrain_histogram(points: DataFrame, value: Column, covered: Column, name: str) -> DataFrame:
    """Share of covered points per bin; no covered point, no rows."""
    counts = points.where(covered).groupBy(value.alias(name)).agg(F.count("*").alias("points"))
    total = F.sum("points").over(_everything())
    return counts.withColumn("fraction", F.col("points") / total)


def _everything():
    from pyspark.sql import Window

    # Only ever applied to the handful of rows left after grouping by bin.
    return Window.partitionBy(F.lit(0))

