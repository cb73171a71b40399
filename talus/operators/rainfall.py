"""Rainfall at the nearest reporting station, trailing windows, gridded rainfall at points.

The windows before a point's as_of are as-of look-ups on running totals. Readings are added up per place and instant once; every
(place, period) gets a strip, the instants of the period and the one before in order of time with their running sums and counts.
A point joins the one strip of its station and period and takes differences of two look-ups per window, so a window costs
the same however many readings lie in it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus import vocab
from talus.functions import geo
from talus.functions.text import once
from talus.operators.spatial import in_held_cells, search_cells, target_cells
from talus.runtime import spread, stored

# Above this many stations in the busiest search cell and period, the nearest one is sought in growing
# circles, the first of which meets about this many.
CROWDED_CELL = 8
# Most stations of a place and period (on average, in the busiest cell) that are looked through as one list.
LIST_STATIONS = 256
PERIOD_SECONDS = float(vocab.LOOKBACK_DAYS * 86400)
# Most instants a strip holds; a place and period with more is joined instant by instant.
STRIP_STEPS = 13
STRIP_INSTANTS = (1 << STRIP_STEPS) - 1
_MM = "decimal(28,10)"
_PLACE = ["station_key", "latitude", "longitude"]


def _period(ts: Column) -> Column:
    """Consecutive periods as long as the lookback: a lookback touches its own and the previous one."""
    return F.floor(geo.epoch_seconds(ts) / F.lit(PERIOD_SECONDS)).cast("long")


def _days_before(ts: Column, days: int) -> Column:
    return ts - F.make_dt_interval(F.lit(days))


def keyed_observations(observations: DataFrame) -> DataFrame:
    key = geo.station_key(F.col("station_id"), F.col("latitude"), F.col("longitude"))
    return observations.where(
        F.col("observed_date").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ).select(key.alias("station_key"), "station_id", "latitude", "longitude", "observed_date", "rainfall_mm")


def instant_totals(observations: DataFrame) -> DataFrame:
    """Readings of one place of a station at one instant added up; a NULL reading counts as 0 mm, once."""
    return (
        keyed_observations(observations)
        .groupBy(*_PLACE, "station_id", "observed_date")
        .agg(F.sum(F.coalesce("rainfall_mm", F.lit(0.0))).alias("mm"), F.count("*").alias("n"))
    )


def period_spans(totals: DataFrame) -> DataFrame:
    """First and last instant and number of instants of every station's place and period."""
    return totals.withColumn("_p", _period(F.col("observed_date"))).groupBy(*_PLACE, "station_id", "_p").agg(
        F.min("observed_date").alias("_first"), F.max("observed_date").alias("_last"), F.count("*").alias("_instants"))


def reporting_sites(spans: DataFrame) -> DataFrame:
    """Per station and period: can a lookback that ends in this period see a reading?

    One row per (site, period) with the first reading of the period itself and the last reading of
    the period before. Both answers follow from two timestamps, so the test for "has data in the
    lookback" is an equi-join instead of a range join over the readings.
    """
    no_time = F.lit(None).cast("timestamp_ntz")
    served = spans.withColumn(
        "_use",
        F.explode(
            F.array(
                F.struct(F.col("_p").alias("period"), F.col("_first").alias("own"), no_time.alias("prev")),
                F.struct((F.col("_p") + 1).alias("period"), no_time.alias("own"), F.col("_last").alias("prev")),
            )
        ),
    )
    return served.groupBy(*_PLACE, "station_id", F.col("_use.period").alias("period")).agg(
        F.min("_use.own").alias("first_own"), F.max("_use.prev").alias("last_prev")
    )


def nearest_station(points: DataFrame, observations: DataFrame, radius_km: float = vocab.STATION_RADIUS_KM,
                    crowded: int = CROWDED_CELL) -> DataFrame:
    """Nearest station within the radius that has a reading in the lookback before each point's as_of.

    Returns (point_id, station_key, station_id, distance_km); distance ties go to the lower key.
    """
    return _nearest(points, period_spans(instant_totals(observations)), radius_km, crowded).select(
        "point_id", "station_key", "station_id", "distance_km")


def _nearest(points: DataFrame, spans: DataFrame, radius_km: float, crowded: int) -> DataFrame:
    """As nearest_station, with the point's place and as_of."""
    sites = stored(reporting_sites(spans))
    # Looked at once per circle and step, so they are stored, dealt over many tasks.
    points = stored(spread(points.select("point_id", "latitude", "longitude", "as_of").where(F.col("as_of").isNotNull())))
    size = geo.cell_size_degrees(radius_km)
    busiest = target_cells(sites, size).groupBy("_row", "_col", "period").count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, math.ceil(busiest / LIST_STATIONS))
    if busiest <= crowded:
        return _nearest_within(points, sites, radius_km, pieces)
    # Whoever finds a station in a small circle needs no larger one, so the work per point stays about
    # the same however densely the stations stand.
    radii = [radius_km]
    while radii[0] > max(0.01, 2 * radius_km * math.sqrt(crowded / busiest)):
        radii.insert(0, radii[0] / 4)
    if len(radii) == 1:
        radii.insert(0, radius_km / 2)
    left, found = points, []
    for radius in radii:
        hit = _nearest_within(left, sites, radius, pieces)
        if radius < radius_km:
            hit = stored(hit)
            left = left.join(hit.select("point_id"), "point_id", "left_anti")
        found.append(hit)
    return reduce(DataFrame.unionByName, found)


def _reports(own: Column, prev: Column, as_of: Column) -> Column:
    return F.coalesce(own <= as_of, F.lit(False)) | F.coalesce(prev >= _days_before(as_of, vocab.LOOKBACK_DAYS), F.lit(False))


def _nearest_within(points: DataFrame, sites: DataFrame, radius_km: float, pieces: int = 1) -> DataFrame:
    """First the least distance of every point, then the stations that stand at it: a least number is found without sorting the
    stations in reach. Stations of one place report together if any does; they are told apart for the points that chose the place."""
    size = geo.cell_size_degrees(radius_km)
    key = ["_row", "_col", "period"]
    near = target_cells(sites, size)
    site = F.struct("station_key", "station_id", "first_own", "last_prev")
    places = near.groupBy(*key, F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"),
                          F.pmod(F.xxhash64("station_key"), F.lit(pieces)).alias("_piece")).agg(
        F.min("first_own").alias("_own"), F.max("last_prev").alias("_prev"), F.collect_list(site).alias("_sites"))

    def meet(seekers: DataFrame) -> DataFrame:
        dated = seekers.where(F.col("as_of").isNotNull()).withColumn("period", _period(F.col("as_of")))
        reach = in_held_cells(search_cells(dated, radius_km, size), near, key[:2])
        distance = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_slat"), F.col("_slon"))
        return reach.join(places, key).where(_reports(F.col("_own"), F.col("_prev"), F.col("as_of"))).withColumn("_d", distance)

    seekers = points.select("point_id", "latitude", "longitude", "as_of")
    least = stored(meet(seekers).where(F.col("_d") <= radius_km).groupBy("point_id").agg(F.min("_d").alias("_least")))
    reporting = F.filter("_sites", lambda s: _reports(s["first_own"], s["last_prev"], F.col("as_of")))
    first = F.array_min(F.transform(reporting, lambda s: F.struct(s["station_key"].alias("station_key"), s["station_id"].alias("station_id"))))
    chosen = meet(seekers.join(least, "point_id")).where(F.col("_d") == F.col("_least")).select(
        "point_id", "latitude", "longitude", "as_of", F.col("_d").alias("distance_km"), first.alias("_first"))
    return (
        chosen.groupBy("point_id", "distance_km")
        .agg(F.min("_first").alias("_best"), *[F.first(c).alias(c) for c in ("latitude", "longitude", "as_of")])
        .select("point_id", "latitude", "longitude", "as_of", "_best.station_key", "_best.station_id", "distance_km")
    )


def lookback_readings(points: DataFrame, nearest: DataFrame, observations: DataFrame,
                      radius_km: float = vocab.STATION_RADIUS_KM, days: int = vocab.LOOKBACK_DAYS) -> DataFrame:
    """Trailing-window range join: the chosen station's readings in [as_of - days, as_of], per point and instant.

    The rows themselves are the result here; sums over them come from `rainfall_summary`, which does not make them. The range
    condition is fed by an equi-join on (station, period).
    """
    chosen = points.select("point_id", "latitude", "longitude", "as_of").join(
        nearest.select("point_id", "station_key"), "point_id"
    ).groupBy("point_id", "station_key", "as_of", "latitude", "longitude").agg(F.count("*").alias("_copies"))
    # Both sides are added up before they meet, so the rows of the result, which are many more, are not shuffled again.
    totals = instant_totals(observations).groupBy(*_PLACE, "observed_date").agg(F.sum("mm").alias("mm"), F.sum("n").alias("n"))
    return _instants(chosen, totals, radius_km, days).select(
        "point_id", "station_key", "as_of", "observed_date", (F.col("mm") * F.col("_copies")).alias("mm"), (F.col("n") * F.col("_copies")).alias("n"))


def _close(radius_km: float) -> Column:
    return geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_slat"), F.col("_slon")) <= radius_km


def _instants(chosen: DataFrame, totals: DataFrame, radius_km: float, days: int = vocab.LOOKBACK_DAYS) -> DataFrame:
    """Points (with their station) joined with every instant of the station's lookback."""
    own = _period(F.col("as_of"))
    wanted = chosen.withColumn("_p", F.explode(F.array(own, own - 1)))
    places = totals.withColumnsRenamed({"latitude": "_slat", "longitude": "_slon"})
    places = places.withColumn("_p", _period(F.col("observed_date")))
    return wanted.join(places, ["station_key", "_p"]).where(
        (F.col("observed_date") <= F.col("as_of")) & (F.col("observed_date") >= _days_before(F.col("as_of"), days)) & _close(radius_km))


def crowded_strips(spans: DataFrame, most: int = STRIP_INSTANTS) -> DataFrame:
    """The places and periods whose strip would have more than `most` instants."""
    site = ["station_key", F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"), "period"]
    counted = spans.withColumn("period", F.explode(F.array(F.col("_p"), F.col("_p") + 1))).groupBy(*site).agg(F.sum("_instants").alias("_rows"))
    return counted.where(F.col("_rows") > most).drop("_rows")


def strips(totals: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """(station_key, _slat, _slon, period, strip), without the places and periods that are `crowded`.

    A strip is an array of (at, mm, run_mm, run_n) in order of time over a period and the one before it. The rows are shuffled
    once, by the keys that points are joined on.
    """
    site = ["station_key", "_slat", "_slon", "period"]
    rows = totals.select(
        "station_key", F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"), F.col("observed_date").alias("at"), "mm", "n"
    ).withColumn("period", F.explode(F.array(_period(F.col("at")), _period(F.col("at")) + 1)))
    if crowded is not None:
        rows = rows.join(crowded, site, "left_anti")
    rows = rows.repartition("station_key", "period").groupBy(*site, "at").agg(F.sum("mm").cast(_MM).alias("mm"), F.sum("n").alias("n"))
    so_far = Window.partitionBy(*site).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"run_mm": F.sum("mm").over(so_far).cast(_MM), "run_n": F.sum("n").over(so_far)})
    strip = F.sort_array(F.collect_list(F.struct("at", "mm", "run_mm", "run_n")))
    return running.groupBy(*site).agg(strip.alias("strip"))


def entries_until(strip: Column, limit: Column, inclusive: bool) -> Column:
    """How many entries of a strip lie before `limit` (or at it, if inclusive), found by halving."""
    def step(found: Column, size: Column) -> Column:
        at = F.get(strip, found + size - 1)["at"]
        inside = at <= limit if inclusive else at < limit
        return F.when(F.coalesce(inside, F.lit(False)), found + size).otherwise(found)

    sizes = F.array(*[F.lit(1 << k) for k in reversed(range(STRIP_STEPS))])
    return F.aggregate(sizes, F.lit(0), step)


def _window_parts(strip: Column, as_of: Column) -> dict[str, Column]:
    """Per window the sum (decimal) and count, as differences of running totals, and the antecedent sum and count."""
    out: dict[str, Column] = {}
    last = F.col("_until")
    total = lambda n, name, zero: F.when(n > 0, F.get(strip, n - 1)[name]).otherwise(F.lit(zero))
    for name, days in {**vocab.WINDOW_DAYS, "antecedent": vocab.ANTECEDENT_DAYS}.items():
        first = F.col(f"_before_{days}")
        out[f"{name}_n"] = total(last, "run_n", 0) - total(first, "run_n", 0)
        if name != "antecedent":
            out[name] = total(last, "run_mm", 0).cast(_MM) - total(first, "run_mm", 0).cast(_MM)
    first = F.col(f"_before_{vocab.ANTECEDENT_DAYS}")
    inside = F.slice(strip, first + 1, F.greatest(last - first, F.lit(0)))
    # Summed as decimals: decayed values often end in an exact half cent of a millimetre, which the
    # order of a floating-point sum (or a running discounted one) would round either way.
    out["antecedent"] = F.aggregate(
        inside, F.lit(0).cast(_MM), lambda acc, x: (acc + decayed(x["mm"].cast("double"), as_of, x["at"])).cast(_MM))
    return out


def decayed(mm: Column, as_of: Column, at: Column) -> Column:
    days_ago = (geo.epoch_seconds(as_of) - geo.epoch_seconds(at)) / F.lit(86400.0)
    return (mm * F.pow(F.lit(vocab.ANTECEDENT_DECAY), F.greatest(days_ago, F.lit(0.0)))).cast("decimal(20,10)")


def _from_strips(chosen: DataFrame, found: DataFrame, radius_km: float) -> DataFrame:
    as_of = F.col("as_of")
    days = sorted({*vocab.WINDOW_DAYS.values(), vocab.ANTECEDENT_DAYS})
    met = chosen.withColumn("period", _period(as_of)).join(found, ["station_key", "period"]).where(_close(radius_km))
    looked = met.select(
        "point_id", "as_of", "strip",
        once(_until=entries_until(F.col("strip"), as_of, True),
             **{f"_before_{k}": entries_until(F.col("strip"), _days_before(as_of, k), False) for k in days}))
    return looked.select("point_id", *[c.alias(n) for n, c in _window_parts(F.col("strip"), as_of).items()])


def _from_instants(chosen: DataFrame, totals: DataFrame, crowded: DataFrame, radius_km: float) -> DataFrame:
    """The same parts for places and periods without a strip, a row per point and instant."""
    dense = chosen.withColumn("period", _period(F.col("as_of"))).join(crowded, ["station_key", "period"]).where(_close(radius_km))
    own = F.col("period")
    places = totals.select("station_key", F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"),
                           F.col("observed_date").alias("at"), "mm", "n").withColumn("_p", _period(F.col("at")))
    rows = dense.withColumn("_p", F.explode(F.array(own, own - 1))).join(places, ["station_key", "_slat", "_slon", "_p"]).where(
        F.col("at") <= F.col("as_of"))
    parts = []
    for name, days in {**vocab.WINDOW_DAYS, "antecedent": vocab.ANTECEDENT_DAYS}.items():
        inside = F.col("at") >= _days_before(F.col("as_of"), days)
        parts.append(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0).cast("long")).alias(f"{name}_n"))
        mm = decayed(F.col("mm"), F.col("as_of"), F.col("at")) if name == "antecedent" else F.col("mm").cast(_MM)
        parts.append(F.coalesce(F.sum(F.when(inside, mm)), F.lit(0)).cast(_MM).alias(name))
    return rows.groupBy("point_id").agg(*parts)


def rainfall_summary(points: DataFrame, observations: DataFrame, radius_km: float = vocab.STATION_RADIUS_KM,
                     crowded: int = CROWDED_CELL, most: int = STRIP_INSTANTS) -> DataFrame:
    """Windows and antecedent index at the nearest reporting station, one row per point.

    A window without readings is NULL with a count of 0; a point without a station keeps its row. The readings are read once.
    """
    totals = stored(instant_totals(observations))
    spans = stored(period_spans(totals))
    # Stored, since it is read for the windows and for the points' own rows.
    chosen = stored(_nearest(points, spans, radius_km, crowded))
    dense = stored(crowded_strips(spans, most))
    if dense.isEmpty():
        parts = _from_strips(chosen, strips(totals), radius_km)
    else:
        parts = _from_strips(chosen, strips(totals, dense), radius_km).unionByName(_from_instants(chosen, totals, dense, radius_km))
    names = [*vocab.WINDOW_DAYS, "antecedent"]
    # A station may have several places; their parts add up.
    added = parts.groupBy("point_id").agg(*[F.sum(c).alias(c) for n in names for c in (n, f"{n}_n")])
    near = chosen.select("point_id", "station_key", "station_id", "distance_km").join(added, "point_id", "left")
    joined = points.join(near, "point_id", "left")
    value = lambda n: F.when(F.col(f"{n}_n") > 0, F.round(F.col(n), 2).cast("double"))
    count = lambda n: F.coalesce(F.col(f"{n}_n"), F.lit(0)).cast("long")
    return joined.select(
        *[points[c] for c in points.columns],
        F.col("station_id").alias("nearest_station_id"),
        F.round("distance_km", 3).alias("nearest_station_distance_km"),
        *[value(n).alias(n) for n in vocab.WINDOW_DAYS],
        value("antecedent").alias("antecedent_rainfall_index"),
        *[count(n).alias(f"{n}_observation_count") for n in names],
        F.col("station_key").isNotNull().alias("rainfall_available"),
    )


def windows_per_location(observations: DataFrame, as_of: Column | None = None) -> DataFrame:
    """24 h and 7 d sums per location, ending at as_of or at the location's latest reading."""
    place = ["latitude", "longitude"]
    usable = observations.where(F.col("observed_date").isNotNull() & F.col("rainfall_mm").isNotNull())
    # Copies collapse first; the sums below then read one row per place and instant.
    totals = usable.groupBy(*place, "observed_date").agg(F.sum("rainfall_mm").alias("mm"))
    if as_of is None:
        ends = usable.groupBy(*place).agg(F.max("observed_date").alias("as_of"))
        totals = totals.join(ends, place)
    else:
        totals = totals.withColumn("as_of", as_of)
    def window(days: int) -> Column:
        inside = F.col("observed_date").between(_days_before(F.col("as_of"), days), F.col("as_of"))
        return F.round(F.sum(F.when(inside, F.col("mm"))), 2)

    return totals.groupBy(*place, "as_of").agg(window(1).alias("rainfall_24h"), window(7).alias("rainfall_7d"))


def valid_grid(grid: DataFrame, fills: tuple[float, ...] = (-9999.0, -999.0)) -> DataFrame:
    """Grid values without fill; any negative value is fill too."""
    return grid.where(~F.col("value").isin(*fills) & (F.col("value") >= 0))


def lookback_days(points: DataFrame, days: int = vocab.GRID_LOOKBACK_DAYS) -> DataFrame:
    """One row per point and day of its lookback, first and last day included."""
    last = F.to_date("as_of")
    return points.where(F.col("as_of").isNotNull()).withColumn(
        "date", F.explode(F.sequence(F.date_sub(last, days), last))
    )


def grid_at_points(points: DataFrame, grid: DataFrame, top: float, left: float, res: float,
                   prefix: str = "grid_", days: int = vocab.GRID_LOOKBACK_DAYS) -> DataFrame:
    """Gridded rainfall at exact points and lookback days, as readings of one pseudo-station per point."""
    row, col = geo.pixel(F.col("latitude"), F.col("longitude"), F.lit(top), F.lit(left), F.lit(res), F.lit(res))
    wanted = lookback_days(points.withColumn("row", row).withColumn("col", col), days)
    return wanted.join(valid_grid(grid), ["date", "row", "col"]).select(
        F.concat(F.lit(prefix), F.col("point_id").cast("string")).alias("station_id"),
        "latitude", "longitude", "date", F.round("value", 2).alias("rainfall_mm"),
    )
