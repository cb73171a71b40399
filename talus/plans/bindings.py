"""Domain tables derived from the supplied parquet tables, once for Spark and once as SQL.

The supplied tables carry no coordinates, so places and readings are computed from their keys with
integer arithmetic that Spark and the checking engine evaluate identically. Every view covers its
whole source table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.text import once
from talus.runtime import prepare, spread


def _mod(c: Column, factor: int, modulus: int) -> Column:
    return F.pmod(c * F.lit(factor), F.lit(modulus))


def _place(key: Column, base: float, factor: int, modulus: int, unit: float) -> Column:
    return F.lit(base) + _mod(key, factor, modulus).cast("double") / F.lit(unit)


def _later(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


class Domain:
    """Lazy domain tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("site_no"),
            F.when(F.pmod(k, F.lit(7)) != 0, F.concat(F.lit("ST"), k.cast("string"))).alias("station_id"),
            _place(k, 26.0, 7919, 2000, 1000.0).alias("latitude"),
            _place(k, 88.0, 104729, 2000, 1000.0).alias("longitude"),
        )

    @cached_property
    def rainfall(self) -> DataFrame:
        k, o = F.col("l_suppkey"), F.col("l_orderkey")
        return self.table("lineitem").select(
            F.concat_ws("-", o.cast("string"), F.col("l_linenumber").cast("string")).alias("source_record_id"),
            F.concat(F.lit("rain_"), F.pmod(k, F.lit(2)).cast("string")).alias("source_id"),
            F.when(F.pmod(k, F.lit(7)) != 0, F.concat(F.lit("ST"), k.cast("string"))).alias("station_id"),
            _place(k, 26.0, 7919, 2000, 1000.0).alias("latitude"),
            _place(k, 88.0, 104729, 2000, 1000.0).alias("longitude"),
            F.when(F.pmod(o, F.lit(50)) != 0, F.col("l_shipdate")).alias("observed_date"),
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("rainfall_mm"),
        )

    @cached_property
    def events(self) -> DataFrame:
        k = F.col("o_orderkey")
        joined = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        )
        return joined.select(
            k.alias("id"),
            _place(k, 26.0, 7919, 20000, 10000.0).alias("latitude"),
            _place(k, 88.0, 104729, 20000, 10000.0).alias("longitude"),
            F.when(F.pmod(k, F.lit(10)) != 0, F.col("n_name")).alias("state"),
            F.when(F.pmod(k, F.lit(3)) != 0, F.concat(F.lit("D"), F.pmod(F.col("o_custkey"), F.lit(50)).cast("string")))
            .alias("district"),
            F.when(F.pmod(k, F.lit(25)) != 0, F.col("o_orderdate")).alias("event_date"),
            F.col("o_orderstatus").alias("event_type"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("severity"),
            F.concat(F.lit("src_"), (F.pmod(k, F.lit(3)) * 20).cast("string")).alias("source_id"),
            F.when(F.pmod(k, F.lit(4)) != 0, k.cast("string")).alias("source_record_id"),
            _later(F.col("o_orderdate"), F.pmod(k, F.lit(1440))).alias("created_at"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        k = F.col("c_custkey")
        base = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                k.alias("id"),
                F.col("c_name").alias("name"),
                F.col("n_name").alias("state"),
                _place(k, 26.0, 7919, 20000, 10000.0).alias("latitude"),
                _place(k, 88.0, 104729, 20000, 10000.0).alias("longitude"),
                _mod(k, 37, 220).cast("double").alias("rainfall_24h"),
                _mod(k, 101, 760).cast("double").alias("rainfall_7d"),
                _mod(k, 13, 105).cast("double").alias("humidity"),
                _mod(k, 7, 40).cast("double").alias("temperature"),
                _mod(k, 17, 70).cast("double").alias("slope"),
                _mod(k, 29, 4000).cast("double").alias("elevation"),
                (_mod(k, 7, 110).cast("double") / F.lit(100.0)).alias("vegetation"),
                (F.pmod(k, F.lit(4)) == 0).alias("historical_landslide"),
                F.when(F.pmod(k, F.lit(3)) == 0, "derived").when(F.pmod(k, F.lit(3)) == 1, "demo_seed")
                .otherwise("external_real").alias("source_type"),
                F.when(F.pmod(k, F.lit(3)) == 0, F.pmod(k, F.lit(20)).cast("int")).alias("historical_event_count"),
                (F.pmod(k, F.lit(5)) == 0).alias("terrain_data_real"),
                _later(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.pmod(k, F.lit(100000))).alias("updated_at"),
                (_mod(k, 31, 1000).cast("double") / F.lit(10.0)).alias("_old"),
            )
        )
        blank = (F.col("source_type") == "derived") & ~F.col("terrain_data_real")
        old = F.col("_old")
        return base.select(
            *[c for c in base.columns if c != "_old"],
            F.when(blank, 0.0).otherwise(old).alias("risk_score"),
            F.when(blank, "UNKNOWN").when(old <= 25, "LOW").when(old <= 50, "MODERATE").when(old <= 75, "HIGH")
            .otherwise("CRITICAL").alias("risk_level"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        k = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "acknowledged")
        return self.table("orders").select(
            k.alias("id"),
            F.col("o_custkey").alias("zone_id"),
            F.concat(F.lit("LANDSLIDE WARNING - Zone "), F.col("o_custkey").cast("string")).alias("title"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"), "CRITICAL").otherwise("HIGH").alias("severity"),
            status.otherwise("resolved").alias("status"),
            (F.col("o_orderstatus") != "F").alias("is_active"),
            (_mod(k, 31, 1000).cast("double") / F.lit(10.0)).alias("risk_score"),
            _later(F.col("o_orderdate"), F.pmod(k, F.lit(1440))).alias("created_at"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        """One registered source per customer; the nations add the sources the events refer to."""
        k = F.col("c_custkey")
        categories = F.array(*[F.lit(x) for x in ["historical_landslide", "rainfall", "terrain", "vegetation", "boundary"]])
        own = self.table("customer").select(
            F.col("c_name").alias("name"),
            F.get(categories, F.pmod(k, F.lit(5)).cast("int")).alias("category"),
            F.concat(F.lit("/data/raw/"), F.col("c_mktsegment"), F.lit("/file_"), k.cast("string"), F.lit(".csv")).alias("file_path"),
            (F.pmod(k, F.lit(6)) != 0).alias("configured"),
            (F.pmod(k, F.lit(8)) != 0).alias("processed"),
            k.alias("source_no"),
        )
        return own.withColumn("source_id", F.replace(F.lower(F.trim(F.col("name"))), F.lit(" "), F.lit("_")))

    @cached_property
    def runs(self) -> DataFrame:
        k = F.col("o_orderkey")
        price = F.col("o_totalprice")
        return self.table("orders").select(
            k.alias("id"),
            F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("source_id"),
            F.floor(price / 100).cast("long").alias("total_records"),
            F.floor(price / 200).cast("long").alias("inserted"),
            F.when(F.col("o_orderstatus") == "F", "failed").otherwise("processed").alias("status"),
            F.when(F.col("o_orderstatus") == "F", "unreadable file").alias("error_summary"),
            _later(F.col("o_orderdate"), F.pmod(k, F.lit(1440))).alias("started_at"),
        )

    @cached_property
    def source_names(self) -> DataFrame:
        return self.table("nation").select(
            F.concat(F.lit("src_"), F.col("n_nationkey").cast("string")).alias("source_id"),
            F.col("n_name").alias("display_name"),
        )

    @cached_property
    def regions(self) -> DataFrame:
        k = F.col("c_custkey")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                k.alias("id"),
                F.concat(F.lit("Region "), k.cast("string")).alias("name"),
                F.col("n_name").alias("state"),
                F.when(F.pmod(k, F.lit(3)) == 0, "external_real").otherwise("derived").alias("source_type"),
            )
        )

    @cached_property
    def polygons(self) -> DataFrame:
        """Nation boundaries as rings: boxes on a 5x5 grid that overlap their neighbours a little;
        some have a hole, some a second part, some no name."""
        n = F.col("n_nationkey")
        left = F.lit(88.0) + F.pmod(n, F.lit(5)).cast("double") * F.lit(0.4)
        bottom = F.lit(26.0) + F.floor(n / F.lit(5)).cast("double") * F.lit(0.4)

        def ring(part: int, ring_no: int, x0: float, y0: float, x1: float, y1: float) -> Column:
            corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
            return F.struct(
                F.lit(part).alias("part"),
                F.lit(ring_no).alias("ring"),
                F.array(*[F.struct((left + dx).alias("x"), (bottom + dy).alias("y")) for dx, dy in corners]).alias("points"),
            )

        outer = ring(0, 0, 0.0, 0.0, 0.45, 0.43)
        hole = ring(0, 1, 0.1, 0.1, 0.2, 0.25)
        second = ring(1, 0, 0.5, 0.1, 0.6, 0.2)
        rings = (
            F.when(F.pmod(n, F.lit(5)) == 0, F.array(outer, hole))
            .when(F.pmod(n, F.lit(5)) == 1, F.array(outer, second))
            .otherwise(F.array(outer))
        )
        return self.table("nation").select(
            n.cast("long").alias("feature"),
            F.when(F.pmod(n, F.lit(7)) != 3, F.col("n_name")).alias("name"),
            rings.alias("rings"),
        )

    def _raster(self, value: Column) -> DataFrame:
        """One raster cell per order: 100 columns of 0.02 degrees, cut into one-degree tiles."""
        k = F.col("o_orderkey")
        row, col = F.floor(k / 100).cast("int"), F.pmod(k, F.lit(100)).cast("int")
        return self.table("orders").select(
            (F.lit(27) - F.floor(row / 50)).cast("int").alias("tile_lat"),
            (F.lit(88) + F.floor(col / 50)).cast("int").alias("tile_lon"),
            F.pmod(row, F.lit(50)).alias("row"),
            F.pmod(col, F.lit(50)).alias("col"),
            value.alias("value"),
        )

    @cached_property
    def dem(self) -> DataFrame:
        k = F.col("o_orderkey")
        row, col = F.floor(k / 100), F.pmod(k, F.lit(100))
        height = (F.lit(2000) + row * 15 + F.pmod(col * col, F.lit(37)) * 40).cast("double")
        return self._raster(F.when(F.pmod(k, F.lit(97)) == 0, F.lit(-9999.0)).otherwise(height))

    @cached_property
    def landcover(self) -> DataFrame:
        codes = F.array(*[F.lit(float(c)) for c in [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0, 77]])
        return self._raster(F.get(codes, F.pmod(F.col("o_orderkey"), F.lit(13)).cast("int")))

    @cached_property
    def rain_grid(self) -> DataFrame:
        k = F.col("l_suppkey")
        value = F.when(F.col("l_linenumber") == 7, F.lit(-9999.0)).when(F.col("l_linenumber") == 6, F.lit(-999.0)).otherwise(
            F.col("l_quantity")
        )
        return (
            self.table("lineitem")
            .select(
                F.to_date("l_shipdate").alias("date"),
                F.pmod(k * 7919, F.lit(8)).cast("int").alias("row"),
                F.pmod(k * 104729 + F.col("l_linenumber"), F.lit(8)).cast("int").alias("col"),
                value.alias("value"),
            )
            .groupBy("date", "row", "col")
            .agg(F.max("value").alias("value"))
        )

    @cached_property
    def payloads(self) -> DataFrame:
        """One landed weather payload per driver event, shaped like the provider's answer."""
        return weather_payloads(spread(self.table("events")))

    @cached_property
    def questions(self) -> DataFrame:
        """One question per conversation turn and customer-style place mention, cycling the intents."""
        k = F.col("o_orderkey")
        place = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
        texts = [
            F.lit("Which place is riskiest right now?"),
            F.lit("How many active alerts are there?"),
            F.concat(F.lit("Weather in "), place),
            F.concat(F.lit("How many landslides in "), place, F.lit("?")),
            F.concat(F.lit("Is "), place, F.lit(" safe?")),
            F.lit("Sing me a song"),
            F.lit("   "),
            F.lit("tell me about nation_1"),
            F.lit("Is Atlantis safe?"),
        ]
        chosen = F.when(F.pmod(k, F.lit(len(texts))) == 0, texts[0])
        for i, text in enumerate(texts[1:], start=1):
            chosen = chosen.when(F.pmod(k, F.lit(len(texts))) == i, text)
        return self.table("orders").select(k.alias("question_id"), chosen.alias("question"))

    @cached_property
    def raw_events(self) -> DataFrame:
        """A messy inventory: every value text, odd headers, bad values, blank cells, copies."""
        k = F.col("l_orderkey")
        ts = F.col("l_shipdate")
        row_key = k * 10 + F.col("l_linenumber")
        lat = F.when(F.pmod(k, F.lit(41)) == 0, "999").when(F.pmod(k, F.lit(43)) == 0, "n/a").when(
            F.pmod(k, F.lit(47)) == 0, "  "
        ).otherwise(_place(k, 26.0, 7919, 20000, 10000.0).cast("string"))
        lon = F.when(F.pmod(k, F.lit(53)) == 0, "-181.5").otherwise(_place(k, 88.0, 104729, 20000, 10000.0).cast("string"))
        text_date = (
            F.when(F.pmod(k, F.lit(6)) == 0, F.date_format(ts, "yyyy-MM-dd"))
            .when(F.pmod(k, F.lit(6)) == 1, F.date_format(ts, "dd/MM/yyyy"))
            .when(F.pmod(k, F.lit(6)) == 2, F.date_format(ts, "yyyy/MM/dd"))
            .when(F.pmod(k, F.lit(6)) == 3, F.date_format(ts, "MM/dd/yyyy HH:mm:ss"))
            .when(F.pmod(k, F.lit(6)) == 4, "")
            .otherwise("soon")
        )
        cells = {
            "record_id": F.when(F.pmod(k, F.lit(2)) == 0, F.concat_ws("-", k.cast("string"), F.col("l_linenumber").cast("string"))),
            "Latitude": lat,
            "lng": lon,
            "Date": text_date,
            "severity": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")),
            "event_type": F.col("l_linestatus"),
            "rain_24h": F.col("l_quantity").cast("string"),
            "Humidity": F.when(F.pmod(k, F.lit(11)) == 0, "140").otherwise(F.pmod(k, F.lit(100)).cast("string")),
            "NDVI": F.when(F.pmod(k, F.lit(13)) == 0, "1.5").otherwise(F.col("l_discount").cast("string")),
            "State": F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit("State "), F.pmod(k, F.lit(9)).cast("string"))),
        }
        return spread(self.table("lineitem")).select(
            row_key.alias("row_key"),
            once(**cells),
            # file order: position of the row in a total order over its values
            F.struct(
                row_key.alias("row_key"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_extendedprice"),
                F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag"), F.col("l_linestatus"),
            ).alias("_order"),
        )


def weather_payloads(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    hours = F.sequence(F.lit(0), F.lit(29))
    iso = "yyyy-MM-dd'T'HH:mm"
    start = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return events.select(
        k.alias("payload_id"),
        F.col("user_id").alias("zone_id"),
        F.col("ts").alias("received_at"),
        (F.col("event_type") != "error").alias("available"),
        F.struct(
            F.when(F.pmod(k, F.lit(17)) != 0, F.date_format(F.col("ts"), iso)).alias("time"),
            F.when(F.col("event_type") != "click", F.round(F.pmod(F.col("value"), F.lit(45.0)), 2)).alias("temperature_2m"),
            F.when(F.col("event_type") != "view", F.pmod(k * 13, F.lit(101)).cast("double")).alias("relative_humidity_2m"),
        ).alias("current"),
        F.struct(
            F.transform(
                hours, lambda h: F.date_format(start + F.make_dt_interval(F.lit(0), F.lit(2) - h), iso)
            ).alias("time"),
            F.when(F.pmod(k, F.lit(19)) == 0, F.array().cast("array<double>")).otherwise(
                F.transform(
                    hours,
                    lambda h: F.when(
                        F.pmod(k + h, F.lit(11)) != 0, F.pmod(k * 7 + h * 3, F.lit(50)).cast("double") / F.lit(10.0)
                    ),
                )
            ).alias("precipitation"),
        ).alias("hourly"),
    )


# The same tables as SQL for the checking engine -------------------------------------------------

VIEWS: dict[str, str] = {
    "stations": """SELECT s_suppkey AS site_no, CASE WHEN s_suppkey % 7 <> 0 THEN 'ST' || s_suppkey END AS station_id,
        26 + CAST((s_suppkey * 7919) % 2000 AS DOUBLE) / 1000 AS latitude,
        88 + CAST((s_suppkey * 104729) % 2000 AS DOUBLE) / 1000 AS longitude FROM supplier""",
    "rain": """SELECT l_orderkey || '-' || l_linenumber AS source_record_id, 'rain_' || (l_suppkey % 2) AS source_id,
        CASE WHEN l_suppkey % 7 <> 0 THEN 'ST' || l_suppkey END AS station_id,
        26 + CAST((l_suppkey * 7919) % 2000 AS DOUBLE) / 1000 AS latitude,
        88 + CAST((l_suppkey * 104729) % 2000 AS DOUBLE) / 1000 AS longitude,
        CASE WHEN l_orderkey % 50 <> 0 THEN l_shipdate END AS observed_date,
        CASE WHEN l_linenumber <> 7 THEN l_quantity END AS rainfall_mm FROM lineitem""",
    "haz": """SELECT o_orderkey AS id, 26 + CAST((o_orderkey * 7919) % 20000 AS DOUBLE) / 10000 AS latitude,
        88 + CAST((o_orderkey * 104729) % 20000 AS DOUBLE) / 10000 AS longitude,
        CASE WHEN o_orderkey % 10 <> 0 THEN n_name END AS state,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'D' || (o_custkey % 50) END AS district,
        CASE WHEN o_orderkey % 25 <> 0 THEN o_orderdate END AS event_date, o_orderstatus AS event_type,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS severity,
        'src_' || (o_orderkey % 3 * 20) AS source_id,
        CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS source_record_id,
        o_orderdate + to_minutes(o_orderkey % 1440) AS created_at
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "zones": """SELECT z.* EXCLUDE (old_score),
        CASE WHEN source_type = 'derived' AND NOT terrain_data_real THEN CAST(0 AS DOUBLE) ELSE old_score END AS risk_score,
        CASE WHEN source_type = 'derived' AND NOT terrain_data_real THEN 'UNKNOWN' WHEN old_score <= 25 THEN 'LOW'
             WHEN old_score <= 50 THEN 'MODERATE' WHEN old_score <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
        FROM (SELECT c_custkey AS id, c_name AS name, n_name AS state,
        26 + CAST((c_custkey * 7919) % 20000 AS DOUBLE) / 10000 AS latitude,
        88 + CAST((c_custkey * 104729) % 20000 AS DOUBLE) / 10000 AS longitude,
        CAST((c_custkey * 37) % 220 AS DOUBLE) AS rainfall_24h, CAST((c_custkey * 101) % 760 AS DOUBLE) AS rainfall_7d,
        CAST((c_custkey * 13) % 105 AS DOUBLE) AS humidity, CAST((c_custkey * 7) % 40 AS DOUBLE) AS temperature,
        CAST((c_custkey * 17) % 70 AS DOUBLE) AS slope, CAST((c_custkey * 29) % 4000 AS DOUBLE) AS elevation,
        CAST((c_custkey * 7) % 110 AS DOUBLE) / 100 AS vegetation, c_custkey % 4 = 0 AS historical_landslide,
        CASE c_custkey % 3 WHEN 0 THEN 'derived' WHEN 1 THEN 'demo_seed' ELSE 'external_real' END AS source_type,
        CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 20 AS INTEGER) END AS historical_event_count,
        c_custkey % 5 = 0 AS terrain_data_real,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey % 100000) AS updated_at,
        CAST((c_custkey * 31) % 1000 AS DOUBLE) / 10 AS old_score
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) z""",
    "alerts": """SELECT o_orderkey AS id, o_custkey AS zone_id, 'LANDSLIDE WARNING - Zone ' || o_custkey AS title,
        CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'acknowledged' ELSE 'resolved' END AS status,
        o_orderstatus <> 'F' AS is_active, CAST((o_orderkey * 31) % 1000 AS DOUBLE) / 10 AS risk_score,
        o_orderdate + to_minutes(o_orderkey % 1440) AS created_at FROM orders""",
    "sources": """SELECT c_name AS name, CASE c_custkey % 5 WHEN 0 THEN 'historical_landslide' WHEN 1 THEN 'rainfall'
        WHEN 2 THEN 'terrain' WHEN 3 THEN 'vegetation' ELSE 'boundary' END AS category,
        '/data/raw/' || c_mktsegment || '/file_' || c_custkey || '.csv' AS file_path,
        c_custkey % 6 <> 0 AS configured, c_custkey % 8 <> 0 AS processed, c_custkey AS source_no,
        replace(lower(trim(c_name)), ' ', '_') AS source_id FROM customer""",
    "runs": """SELECT o_orderkey AS id, 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS source_id,
        CAST(floor(o_totalprice / 100) AS BIGINT) AS total_records, CAST(floor(o_totalprice / 200) AS BIGINT) AS inserted,
        CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'processed' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN 'unreadable file' END AS error_summary,
        o_orderdate + to_minutes(o_orderkey % 1440) AS started_at FROM orders""",
    "source_names": "SELECT 'src_' || n_nationkey AS source_id, n_name AS display_name FROM nation",
    "regions": """SELECT c_custkey AS id, 'Region ' || c_custkey AS name, n_name AS state,
        CASE WHEN c_custkey % 3 = 0 THEN 'external_real' ELSE 'derived' END AS source_type
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "rings": """SELECT CAST(n_nationkey AS BIGINT) AS feature, CASE WHEN n_nationkey % 7 <> 3 THEN n_name END AS name,
        part, ring, 88 + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(x0 AS DOUBLE) AS x0,
        26 + CAST(n_nationkey // 5 AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(y0 AS DOUBLE) AS y0,
        88 + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(x1 AS DOUBLE) AS x1,
        26 + CAST(n_nationkey // 5 AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(y1 AS DOUBLE) AS y1
        FROM nation JOIN (VALUES (0, 0, 0.0, 0.0, 0.45, 0.43, -1), (0, 1, 0.1, 0.1, 0.2, 0.25, 0),
                                 (1, 0, 0.5, 0.1, 0.6, 0.2, 1)) r(part, ring, x0, y0, x1, y1, kind)
        ON kind = -1 OR n_nationkey % 5 = kind""",
    "edges": """SELECT feature, name, part, ring, px, py, qx, qy FROM (
        SELECT *, x0 AS px, y0 AS py, x1 AS qx, y0 AS qy FROM rings UNION ALL
        SELECT *, x1, y0, x1, y1 FROM rings UNION ALL SELECT *, x1, y1, x0, y1 FROM rings UNION ALL
        SELECT *, x0, y1, x0, y0 FROM rings)""",
    "dem": """SELECT CAST(27 - (o_orderkey // 100) // 50 AS INTEGER) AS tile_lat,
        CAST(88 + (o_orderkey % 100) // 50 AS INTEGER) AS tile_lon,
        CAST((o_orderkey // 100) % 50 AS INTEGER) AS "row", CAST((o_orderkey % 100) % 50 AS INTEGER) AS col,
        CASE WHEN o_orderkey % 97 = 0 THEN CAST(-9999 AS DOUBLE)
        ELSE CAST(2000 + (o_orderkey // 100) * 15 + ((o_orderkey % 100) * (o_orderkey % 100)) % 37 * 40 AS DOUBLE) END AS value
        FROM orders""",
    "lc": """SELECT CAST(27 - (o_orderkey // 100) // 50 AS INTEGER) AS tile_lat,
        CAST(88 + (o_orderkey % 100) // 50 AS INTEGER) AS tile_lon,
        CAST((o_orderkey // 100) % 50 AS INTEGER) AS "row", CAST((o_orderkey % 100) % 50 AS INTEGER) AS col,
        CAST(list_extract([10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0, 77], CAST(o_orderkey % 13 AS INTEGER) + 1) AS DOUBLE) AS value
        FROM orders""",
    "dem_tiles": """SELECT tile_lat, tile_lon, CAST(tile_lon AS DOUBLE) AS "left", CAST(tile_lat + 1 AS DOUBLE) AS top,
        CAST(0.02 AS DOUBLE) AS res_x, CAST(0.02 AS DOUBLE) AS res_y, max(col) + 1 AS width, max("row") + 1 AS height
        FROM dem GROUP BY 1, 2""",
    "lc_tiles": """SELECT tile_lat, tile_lon, CAST(tile_lon AS DOUBLE) AS "left", CAST(tile_lat + 1 AS DOUBLE) AS top,
        CAST(0.02 AS DOUBLE) AS res_x, CAST(0.02 AS DOUBLE) AS res_y, max(col) + 1 AS width, max("row") + 1 AS height
        FROM lc GROUP BY 1, 2""",
    "rain_grid": """SELECT CAST(l_shipdate AS DATE) AS "date", CAST((l_suppkey * 7919) % 8 AS INTEGER) AS "row",
        CAST((l_suppkey * 104729 + l_linenumber) % 8 AS INTEGER) AS col,
        max(CASE l_linenumber WHEN 7 THEN CAST(-9999 AS DOUBLE) WHEN 6 THEN CAST(-999 AS DOUBLE) ELSE l_quantity END) AS value
        FROM lineitem GROUP BY 1, 2, 3""",
    "payloads": """SELECT event_id AS payload_id, user_id AS zone_id, ts AS received_at, event_type <> 'error' AS available,
        CASE WHEN event_id % 17 <> 0 THEN date_trunc('minute', ts) END AS cur_time,
        CASE WHEN event_type <> 'click' THEN round(value % CAST(45 AS DOUBLE), 2) END AS temperature,
        CASE WHEN event_type <> 'view' THEN CAST((event_id * 13) % 101 AS DOUBLE) END AS humidity FROM events""",
    "hours": """SELECT p.payload_id, h, date_trunc('hour', received_at) + to_hours(2 - h) AS sample_time,
        CASE WHEN p.payload_id % 19 <> 0 AND (p.payload_id + h) % 11 <> 0
             THEN CAST((p.payload_id * 7 + h * 3) % 50 AS DOUBLE) / 10 END AS mm
        FROM payloads p, (SELECT CAST(range AS BIGINT) AS h FROM range(30))""",
    "readings": """SELECT p.*, CASE WHEN n > 0 THEN round(mm, 2) END AS rainfall_24h FROM payloads p LEFT JOIN
        (SELECT h.payload_id, count(mm) AS n, sum(mm) AS mm FROM hours h JOIN payloads q ON h.payload_id = q.payload_id
         WHERE q.cur_time IS NULL OR (sample_time <= q.cur_time AND sample_time >= q.cur_time - INTERVAL 24 HOUR)
         GROUP BY 1) USING (payload_id)""",
    "questions": """SELECT o_orderkey AS question_id, CASE o_orderkey % 9
        WHEN 0 THEN 'Which place is riskiest right now?' WHEN 1 THEN 'How many active alerts are there?'
        WHEN 2 THEN 'Weather in ' || p WHEN 3 THEN 'How many landslides in ' || p || '?'
        WHEN 4 THEN 'Is ' || p || ' safe?' WHEN 5 THEN 'Sing me a song' WHEN 6 THEN '   '
        WHEN 7 THEN 'tell me about nation_1' ELSE 'Is Atlantis safe?' END AS question
        FROM (SELECT *, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS p FROM orders)""",
    "raw_events": """SELECT l_orderkey * 10 + l_linenumber AS row_key,
        CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey || '-' || l_linenumber END AS record_id,
        CASE WHEN l_orderkey % 41 = 0 THEN '999' WHEN l_orderkey % 43 = 0 THEN 'n/a' WHEN l_orderkey % 47 = 0 THEN '  '
             ELSE CAST(26 + CAST((l_orderkey * 7919) % 20000 AS DOUBLE) / 10000 AS VARCHAR) END AS "Latitude",
        CASE WHEN l_orderkey % 53 = 0 THEN '-181.5'
             ELSE CAST(88 + CAST((l_orderkey * 104729) % 20000 AS DOUBLE) / 10000 AS VARCHAR) END AS lng,
        CASE l_orderkey % 6 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%d/%m/%Y')
             WHEN 2 THEN strftime(l_shipdate, '%Y/%m/%d') WHEN 3 THEN strftime(l_shipdate, '%m/%d/%Y %H:%M:%S')
             WHEN 4 THEN '' ELSE 'soon' END AS "Date",
        CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS severity, l_linestatus AS event_type,
        CAST(l_quantity AS VARCHAR) AS rain_24h,
        CASE WHEN l_orderkey % 11 = 0 THEN '140' ELSE CAST(l_orderkey % 100 AS VARCHAR) END AS "Humidity",
        CASE WHEN l_orderkey % 13 = 0 THEN '1.5' ELSE CAST(l_discount AS VARCHAR) END AS "NDVI",
        CASE WHEN l_orderkey % 5 = 0 THEN 'State ' || (l_orderkey % 9) END AS "State",
        row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
            l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS idx
        FROM lineitem""",
}


def with_views(body: str, **extra: str) -> str:
    """Prefix a query with the views it names, in dependency order. `extra` adds local views."""
    wanted: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(VIEWS[name])
                wanted[name] = VIEWS[name]

    for text in [*extra.values(), body]:
        visit(text)
    parts = {**wanted, **extra}
    if not parts:
        return body
    recursive = "RECURSIVE " if any("/*recursive*/" in v for v in extra.values()) else ""
    return "WITH " + recursive + ",\n".join(f"{n} AS ({v})" for n, v in parts.items()) + "\n" + body
