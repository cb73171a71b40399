"""Raster cells, terrain, land cover, gridded rainfall."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import geo, terrain
from talus.operators import rainfall, raster
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.fragments import d
from talus.plans.catalog.spatial import points

query = CATALOG.query


def dem(dom: Domain):
    return dom.dem, raster.summarize(dom.dem, 0.02, -9999.0)


def landcover(dom: Domain):
    return dom.landcover, raster.summarize(dom.landcover, 0.02, 0.0)


@query("s07_raster_summary", """SELECT *, "left" + width * res_x AS "right", top - height * res_y AS bottom,
    CAST(-9999 AS DOUBLE) AS nodata, true AS geographic, 'EPSG:4326' AS crs FROM dem_tiles""")
def s07(dom: Domain):
    return raster.bounds(dem(dom)[1])


@query("s08_valid_grid", "SELECT * FROM rain_grid WHERE value <> -9999 AND value <> -999 AND value >= 0")
def s08(dom: Domain):
    return rainfall.valid_grid(dom.rain_grid)


def pixel_view(table: str, tiles: str) -> str:
    return f"""SELECT p.*, t.*, floor((top - latitude) / res_y) AS pr, floor((longitude - "left") / res_x) AS pc
        FROM {table} p LEFT JOIN {tiles} t ON t.tile_lat = floor(p.latitude) AND t.tile_lon = floor(p.longitude)"""


COVERED = "coalesce(pr >= 0 AND pr < height AND pc >= 0 AND pc < width, false)"


@query("p32_pixel_address", f"""SELECT id, CAST(pr AS INTEGER) AS "row", CAST(pc AS INTEGER) AS col, {COVERED} AS covered FROM px""",
       px=pixel_view("haz", "dem_tiles"))
def p32(dom: Domain):
    return raster.to_pixels(dom.events.select("id", "latitude", "longitude"), dem(dom)[1]).select("id", "row", "col", "covered")


LEGEND = """CASE CAST({c} AS INTEGER) WHEN 10 THEN 'forest' WHEN 20 THEN 'grassland' WHEN 30 THEN 'grassland' WHEN 40 THEN 'cropland'
    WHEN 50 THEN 'urban' WHEN 60 THEN 'bare_land' WHEN 70 THEN 'bare_land' WHEN 80 THEN 'water' WHEN 90 THEN 'water'
    WHEN 95 THEN 'forest' WHEN 100 THEN 'bare_land' ELSE 'unknown' END"""


@query("p22_landcover_category", f"""SELECT tile_lat, tile_lon, "row", col, {LEGEND.format(c='value')} AS category, 'unknown' AS unnamed FROM lc""")
def p22(dom: Domain):
    return dom.landcover.select("tile_lat", "tile_lon", "row", "col",
                                terrain.landcover_category(F.col("value"), "esa_worldcover").alias("category"),
                                terrain.landcover_category(F.col("value"), None).alias("unnamed"))


LC_VIEWS = {
    "px": pixel_view("haz", "lc_tiles"),
    "seen": f"""SELECT px.id, CASE WHEN {COVERED} AND c.value <> 0 THEN CAST(c.value AS INTEGER) END AS raw_class
        FROM px LEFT JOIN lc c ON c.tile_lat = px.tile_lat AND c.tile_lon = px.tile_lon AND c."row" = pr AND c.col = pc""",
}


@query("j08_landcover_at_points", f"""SELECT id, raw_class, CASE WHEN raw_class IS NOT NULL THEN {LEGEND.format(c='raw_class')} END AS landcover_category,
    raw_class IS NOT NULL AS landcover_available FROM seen""", **LC_VIEWS)
def j08(dom: Domain):
    return raster.landcover(dom.events.select("id", "latitude", "longitude"), *landcover(dom)).drop("latitude", "longitude")


@query("j08_wide_tiles", """SELECT id, CASE WHEN c.value <> 0 THEN CAST(c.value AS INTEGER) END AS raw_class FROM wpx LEFT JOIN lc c
    ON c.tile_lat = wlat + 2 - floor(pr / 50) AND c."row" = pr - 50 * floor(pr / 50) AND c.tile_lon = wlon + floor(pc / 50) AND c.col = pc - 50 * floor(pc / 50)
    AND pr BETWEEN 0 AND 149 AND pc BETWEEN 0 AND 149""",
       wpx=f"""SELECT id, wlat, wlon, floor((wlat + 3 - latitude) / {d(0.02)}) AS pr, floor((longitude - wlon) / {d(0.02)}) AS pc FROM
           (SELECT *, floor(latitude / 3) * 3 AS wlat, floor(longitude / 3) * 3 AS wlon FROM haz)""")
def j08w(dom: Domain):
    """The same land cover in tiles of three degrees."""
    cells, tiles = landcover(dom)
    side = F.floor(F.col("tile_lat") / 3) * 3
    wide = cells.join(F.broadcast(tiles.select("tile_lat", "tile_lon", "height", "width")), ["tile_lat", "tile_lon"]).select(
        side.cast("int").alias("tile_lat"), (F.floor(F.col("tile_lon") / 3) * 3).cast("int").alias("tile_lon"),
        (F.col("row") + (side + 2 - F.col("tile_lat")) * F.col("height")).cast("int").alias("row"),
        (F.col("col") + F.pmod("tile_lon", F.lit(3)) * F.col("width")).cast("int").alias("col"), "value")
    meta = raster.summarize(wide, 0.02, 0.0, degrees=3)
    return raster.landcover(dom.events.select("id", "latitude", "longitude"), wide, meta, degrees=3).select("id", "raw_class")


def terrain_views(table: str, key: str = "id", across: bool = True) -> dict[str, str]:
    down, right = ("floor((pr + dr) / height)", "floor((pc + dc) / width)") if across else ("0", "0")
    z = lambda r, c: f"max(CASE WHEN dr = {r} AND dc = {c} THEN value END)"
    sx = f"(8 * res_x * {d(111320)} * cos(radians(latitude)))"
    sy = f"(8 * res_y * {d(111320)})"
    east, west = f"({z(-1, 1)} + 2 * {z(0, 1)} + {z(1, 1)})", f"({z(-1, -1)} + 2 * {z(0, -1)} + {z(1, -1)})"
    south, north = f"({z(1, -1)} + 2 * {z(1, 0)} + {z(1, 1)})", f"({z(-1, -1)} + 2 * {z(-1, 0)} + {z(-1, 1)})"
    return {
        "px": pixel_view(table, "dem_tiles"),
        "around": f"""SELECT px.{key} AS pid, dr, dc, value FROM px, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc), dem c
            WHERE {COVERED} AND c.tile_lat = px.tile_lat - {down} AND c.tile_lon = px.tile_lon + {right}
            AND c."row" = pr + dr - {down} * height AND c.col = pc + dc - {right} * width""",
        "block": f"""SELECT px.{key} AS pid, count(value) AS n, {z(0, 0)} AS centre, ({east} - {west}) / {sx} AS gx, ({south} - {north}) / {sy} AS gy
            FROM px LEFT JOIN around ON pid = px.{key} GROUP BY px.{key}, latitude, res_x, res_y""",
        "ter": """SELECT pid, CASE WHEN centre <> -9999 THEN round(centre, 2) END AS elevation_m,
            CASE WHEN centre <> -9999 AND n = 9 THEN round(degrees(atan(sqrt(gx * gx + gy * gy))), 3) END AS slope_degrees,
            CASE WHEN centre <> -9999 AND n = 9 AND (gx <> 0 OR gy <> 0) THEN round(CASE WHEN b < 0 THEN b + 360 WHEN b > 360 THEN b - 360 ELSE b END, 3) END AS aspect_degrees,
            coalesce(centre <> -9999, false) AS terrain_available FROM (SELECT *, 90 - degrees(atan2(gy, -gx)) AS b FROM block)""",
    }


@query("j09_terrain_at_points", "SELECT pid AS id, elevation_m, slope_degrees, aspect_degrees, terrain_available FROM ter", **terrain_views("haz"))
def j09(dom: Domain):
    return raster.terrain_features(dom.events.select("id", "latitude", "longitude"), *dem(dom)).drop("latitude", "longitude")


@query("p30_slope_aspect", """SELECT tile_lat, tile_lon, r AS "row", c AS col,
    round(degrees(atan(sqrt(gx * gx + gy * gy))), 3) AS slope, CASE WHEN gx <> 0 OR gy <> 0 THEN
      round(CASE WHEN b < 0 THEN b + 360 WHEN b > 360 THEN b - 360 ELSE b END, 3) END AS aspect
    FROM (SELECT *, 90 - degrees(atan2(gy, -gx)) AS b FROM (SELECT tile_lat, tile_lon, r, c,
      ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / (8 * 500) AS gx, ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / (8 * 500) AS gy FROM grid9 WHERE n = 9))""",
       grid9="""SELECT a.tile_lat, a.tile_lon, a."row" AS r, a.col AS c, count(*) AS n, """ + ", ".join(
           f"""max(CASE WHEN b."row" = a."row" + {i - 1} AND b.col = a.col + {j - 1} THEN b.value END) AS z{i}{j}""" for i in range(3) for j in range(3)
       ) + """ FROM dem a JOIN dem b ON a.tile_lat = b.tile_lat AND a.tile_lon = b.tile_lon AND b."row" BETWEEN a."row" - 1 AND a."row" + 1
           AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3, 4""")
def p30(dom: Domain):
    blocks = raster.neighbourhoods(dom.dem, dom.dem).where("n = 9")
    block = {(dr, dc): F.col(f"z{dr + 1}{dc + 1}") for dr, dc in raster.OFFSETS}
    slope, aspect = terrain.horn(block, F.lit(500.0), F.lit(500.0))
    return blocks.select("tile_lat", "tile_lon", "row", "col", slope.alias("slope"), aspect.alias("aspect"))


@query("p21_slope_bin", """SELECT id, CASE WHEN slope < 10 THEN '<10' WHEN slope < 20 THEN '10-20' WHEN slope < 30 THEN '20-30'
    WHEN slope < 40 THEN '30-40' WHEN slope IS NULL THEN 'unknown' ELSE '40+' END AS slope_bin FROM zones""")
def p21(dom: Domain):
    return dom.zones.select("id", terrain.slope_bin(F.col("slope")).alias("slope_bin"))


@query("p23_aspect_parts", """SELECT id, coalesce(round(sin(radians(a)), 6), 0) AS aspect_sin, coalesce(round(cos(radians(a)), 6), 0) AS aspect_cos
    FROM (SELECT id, CASE WHEN id % 9 <> 0 THEN rainfall_7d * 360 / 760 END AS a FROM zones)""")
def p23(dom: Domain):
    aspect = F.when(F.pmod("id", F.lit(9)) != 0, F.col("rainfall_7d") * 360 / 760)
    sin, cos = terrain.aspect_parts(aspect)
    return dom.zones.select("id", sin.alias("aspect_sin"), cos.alias("aspect_cos"))


CATS = ["forest", "grassland", "cropland", "urban", "bare_land", "water", "unknown"]


@query("p24_landcover_one_hot", "SELECT id, " + ", ".join(
    f"CAST(CASE WHEN coalesce(c, 'unknown') = '{x}' THEN 1 ELSE 0 END AS DOUBLE) AS landcover_{x}" for x in CATS)
    + f" FROM (SELECT id, CASE WHEN raw_class IS NOT NULL THEN {LEGEND.format(c='raw_class')} END AS c FROM seen)", **LC_VIEWS)
def p24(dom: Domain):
    seen = raster.landcover(dom.events.select("id", "latitude", "longitude"), *landcover(dom))
    return seen.select("id", *[v.alias(k) for k, v in terrain.landcover_one_hot(F.col("landcover_category")).items()])


@query("p31_tile_ids", """SELECT id, CAST(floor(latitude) AS INTEGER) AS dem_lat, CAST(floor(longitude) AS INTEGER) AS dem_lon,
    CAST(floor(latitude / 3) * 3 AS INTEGER) AS landcover_lat, CAST(floor(longitude / 3) * 3 AS INTEGER) AS landcover_lon FROM haz""")
def p31(dom: Domain):
    a, b = geo.one_degree_tile(F.col("latitude"), F.col("longitude"))
    c, e = geo.three_degree_tile(F.col("latitude"), F.col("longitude"))
    return dom.events.select("id", a.alias("dem_lat"), b.alias("dem_lon"), c.alias("landcover_lat"), e.alias("landcover_lon"))


@query("p31_tiles_for_boxes", """SELECT id, CAST(a.range AS INTEGER) AS tile_lat, CAST(b.range AS INTEGER) AS tile_lon FROM zones,
    range(20, 35) a, range(80, 95) b WHERE a.range BETWEEN floor(latitude - 1) AND floor(latitude + 1)
    AND b.range BETWEEN floor(longitude - 1) AND floor(longitude + 1)""")
def p31b(dom: Domain):
    boxes = dom.zones.select("id", (F.col("latitude") - 1).alias("min_lat"), (F.col("latitude") + 1).alias("max_lat"),
                             (F.col("longitude") - 1).alias("min_lon"), (F.col("longitude") + 1).alias("max_lon"))
    return raster.tiles_for_boxes(boxes, 1).select("id", "tile_lat", "tile_lon")


@query("u02_tiles_needed", """SELECT DISTINCT CAST(floor(latitude) AS INTEGER) AS dem_lat, CAST(floor(longitude) AS INTEGER) AS dem_lon,
    CAST(floor(latitude / 3) * 3 AS INTEGER) AS landcover_lat, CAST(floor(longitude / 3) * 3 AS INTEGER) AS landcover_lon FROM haz""")
def u02(dom: Domain):
    return raster.tiles_for_points(dom.events)


@query("j10_fill_zone_terrain", """SELECT z.id, CASE WHEN terrain_available THEN elevation_m ELSE elevation END AS elevation,
    CASE WHEN terrain_available THEN coalesce(slope_degrees, 0) ELSE slope END AS slope,
    terrain_data_real OR terrain_available AS terrain_data_real
    FROM zones z JOIN ter ON pid = z.id WHERE source_type = 'derived' AND NOT terrain_data_real""", **terrain_views("zones", across=False))
def j10(dom: Domain):
    return raster.fill_zone_terrain(dom.zones, *dem(dom)).select("id", "elevation", "slope", "terrain_data_real")


GRID_POINTS = "SELECT id AS point_id, latitude, longitude, coalesce(event_date, created_at) AS as_of FROM haz"


@query("j11_grid_rainfall", f"""SELECT 'grid_' || point_id AS station_id, latitude, longitude, g."date", round(value, 2) AS rainfall_mm
    FROM pts p JOIN rain_grid g ON g."date" BETWEEN CAST(as_of AS DATE) - 31 AND CAST(as_of AS DATE)
    AND g."row" = floor((28 - latitude) / {d(0.25)}) AND g.col = floor((longitude - 88) / {d(0.25)}) WHERE value >= 0""", pts=GRID_POINTS)
def j11(dom: Domain):
    return rainfall.grid_at_points(points(dom), dom.rain_grid, 28.0, 88.0, 0.25)


@query("u03_days_needed", """SELECT DISTINCT CAST(d.range AS DATE) AS "date" FROM (SELECT min(CAST(as_of AS DATE)) AS a, max(CAST(as_of AS DATE)) AS b FROM pts) m,
    range(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', INTERVAL 1 DAY) d WHERE EXISTS (SELECT 1 FROM days p WHERE
    CAST(d.range AS DATE) BETWEEN p.day - 31 AND p.day)""", pts=GRID_POINTS, days="SELECT DISTINCT CAST(as_of AS DATE) AS day FROM pts")
def u03(dom: Domain):
    # Distinct end days first: the lookback is unfolded per day, not per point.
    days = points(dom).select(F.to_date("as_of").alias("as_of")).distinct()
    return rainfall.lookback_days(days).select("date").distinct()


@query("w06_mosaic", """SELECT r AS "row", c AS col, arg_min(value, layer) AS value FROM (
    SELECT (27 - tile_lat) * 50 + "row" AS r, (tile_lon - 88) * 50 + col AS c, value, 0 AS layer FROM dem WHERE value <> -9999
    UNION ALL SELECT CAST(p_partkey // 100 AS INTEGER), CAST(p_partkey % 100 AS INTEGER), p_retailprice, 1 FROM part
    UNION ALL SELECT (27 - tile_lat) * 50 + "row", (tile_lon - 88) * 50 + col, value, 2 FROM lc WHERE value <> 0) GROUP BY 1, 2""")
def w06(dom: Domain):
    globe = lambda df: df.select(((27 - F.col("tile_lat")) * 50 + F.col("row")).alias("row"),
                                 ((F.col("tile_lon") - 88) * 50 + F.col("col")).alias("col"), "value")
    prices = dom.table("part").select(F.floor(F.col("p_partkey") / 100).cast("int").alias("row"),
                                      F.pmod("p_partkey", F.lit(100)).cast("int").alias("col"), F.col("p_retailprice").alias("value"))
    return raster.mosaic([(globe(dom.dem), -9999.0), (prices, None), (globe(dom.landcover), 0.0)])


@query("a17_terrain_histogram", """SELECT bin, n AS points, n / sum(n) OVER () AS fraction FROM (SELECT CASE WHEN slope_degrees < 10 THEN '<10'
    WHEN slope_degrees < 20 THEN '10-20' WHEN slope_degrees < 30 THEN '20-30' WHEN slope_degrees < 40 THEN '30-40' ELSE '40+' END AS bin,
    count(*) AS n FROM ter WHERE slope_degrees IS NOT NULL GROUP BY 1)""", **terrain_views("haz"))
def a17(dom: Domain):
    seen = raster.terrain_features(dom.events.select("id", "latitude", "longitude"), *dem(dom))
    return raster.terrain_histogram(seen, terrain.slope_bin(F.col("slope_degrees")), F.col("slope_degrees").isNotNull(), "bin")
