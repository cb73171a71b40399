"""Feature vectors, clustering, sampling, model runs."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from talus import vocab
from talus.operators import cluster, features, model, sampling
from talus.plans import susceptibility, zones
from talus.plans.bindings import Domain
from talus.plans.catalog import CATALOG
from talus.plans.catalog.fragments import POINTS, d, hav, nearest_views, window_sql
from talus.plans.catalog.rasters import COVERED, LEGEND, dem, landcover, pixel_view, terrain_views
from talus.plans.catalog.spatial import CONTAINED, HITS, points
from talus.runtime import work_path
from talus.sources import sinks

query = CATALOG.query
BOX = (26.0, 88.0, 28.0, 90.0)


def feature_views(pts: str) -> dict[str, str]:
    return {
        **nearest_views(pts),
        "rainw": f"SELECT point_id, {window_sql()} FROM readings30 GROUP BY point_id",
        **terrain_views("pts", "point_id"),
        "pxl": pixel_view("pts", "lc_tiles"),
        "cover": f"""SELECT pxl.point_id, CASE WHEN {COVERED} AND c.value <> 0 THEN CAST(c.value AS INTEGER) END AS raw_class
            FROM pxl LEFT JOIN lc c ON c.tile_lat = pxl.tile_lat AND c.tile_lon = pxl.tile_lon AND c."row" = pr AND c.col = pc""",
        "hitcount": HITS,
        "feat": f"""SELECT p.*, rainfall_24h, rainfall_72h, rainfall_7d, rainfall_30d, antecedent_rainfall_index, n.point_id IS NOT NULL AS rainfall_available,
            elevation_m, slope_degrees, aspect_degrees, terrain_available, CASE WHEN raw_class IS NOT NULL THEN {LEGEND.format(c='raw_class')} END AS landcover_category,
            raw_class IS NOT NULL AS landcover_available, CAST(coalesce(h.n, 0) AS BIGINT) AS historical_landslide_count,
            round(coalesce(h.n, 0) / (pi() * 100), 6) AS historical_landslide_density_per_km2
            FROM pts p LEFT JOIN near n ON n.point_id = p.point_id LEFT JOIN rainw w ON w.point_id = p.point_id LEFT JOIN ter ON ter.pid = p.point_id
            LEFT JOIN cover c ON c.point_id = p.point_id LEFT JOIN hitcount h ON h.point_id = p.point_id""",
    }


COLUMNS = ["point_id", *vocab.WINDOW_DAYS, "antecedent_rainfall_index", "rainfall_available", "elevation_m", "slope_degrees", "aspect_degrees",
           "terrain_available", "landcover_category", "landcover_available", "historical_landslide_count", "historical_landslide_density_per_km2"]
CRITICAL = "terrain_available AND landcover_available AND " + " AND ".join(f"{f} IS NOT NULL" for f in vocab.CRITICAL_FIELDS)
LABELLED = """SELECT 'event_' || id AS point_id, latitude, longitude, coalesce(event_date, created_at) AS as_of, 1 AS label FROM haz UNION ALL
    SELECT 'negative_' || id, 26 + CAST((id * 6007) % 20000 AS DOUBLE) / 10000, 88 + CAST((id * 48611) % 20000 AS DOUBLE) / 10000,
    TIMESTAMP '1995-02-01' + to_days(CAST(id % 2300 AS INTEGER)), 0 FROM zones"""


def given_negatives(dom: Domain):
    """A fixed set of absence points, one per zone, in places and on days of their own."""
    place = lambda base, factor: F.lit(base) + F.pmod(F.col("id") * factor, F.lit(20000)).cast("double") / F.lit(10000.0)
    day = F.lit("1995-02-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.pmod("id", F.lit(2300)).cast("int"))
    return dom.zones.select(F.concat(F.lit("negative_"), F.col("id").cast("string")).alias("point_id"),
                            place(26.0, 6007).alias("latitude"), place(88.0, 48611).alias("longitude"), day.alias("as_of"))


def labelled_features(dom: Domain):
    return susceptibility.training_set(features.event_points(dom.events), given_negatives(dom), dom.rainfall, dem(dom), landcover(dom), dom.events)


@query("c04_feature_vectors", "SELECT " + ", ".join(COLUMNS) + " FROM feat", **feature_views(POINTS))
def c04(dom: Domain):
    return features.build(points(dom), dom.rainfall, dem(dom), landcover(dom), dom.events).select(*COLUMNS)


@query("c05_training_set", "SELECT label, " + ", ".join(COLUMNS) + f" FROM feat WHERE {CRITICAL}", **feature_views(LABELLED))
def c05(dom: Domain):
    return features.training_rows(labelled_features(dom)).select("label", *COLUMNS)


@query("a19_training_metadata", f"""SELECT count(*) FILTER (ok AND label = 1) AS positive_count, count(*) FILTER (ok AND label = 0) AS negative_count,
    count(*) FILTER (NOT ok) AS rows_dropped_missing_features FROM (SELECT label, {CRITICAL} AS ok FROM feat)""", **feature_views(LABELLED))
def a19(dom: Domain):
    return features.training_metadata(labelled_features(dom))


@query("a27_availability_counts", """SELECT count(*) AS "rows", count(*) FILTER (rainfall_available) AS rainfall, count(*) FILTER (terrain_available) AS terrain,
    count(*) FILTER (landcover_available) AS landcover FROM feat""", **feature_views(POINTS))
def a27(dom: Domain):
    return features.availability_counts(features.build(points(dom), dom.rainfall, dem(dom), landcover(dom), dom.events))


# Clustering ------------------------------------------------------------------------------------
EPS = 0.06
CLUSTERS = {
    "ev": "SELECT id, state, latitude, longitude FROM haz WHERE state IN (SELECT name FROM rings WHERE name IS NOT NULL)",
    "pairs": f"""SELECT a.id AS a, b.id AS b FROM ev a JOIN ev b ON a.state = b.state AND b.latitude BETWEEN a.latitude - {d(0.07)} AND a.latitude + {d(0.07)}
        AND sqrt((a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude)) <= {d(EPS)}""",
    "reach": "/*recursive*/ SELECT id, id AS root FROM ev UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id",
    "labels": "SELECT id, min(root) AS cluster FROM reach GROUP BY id",
}


def clusters(dom: Domain):
    names = dom.polygons.select(F.col("name").alias("state"))
    return cluster.cluster(zones.known_states(dom.events.select("id", "state", "latitude", "longitude"), names), EPS)


@query("c01_clusters", "SELECT id, cluster FROM labels", **CLUSTERS)
def c01(dom: Domain):
    return clusters(dom).select("id", "cluster")


# Coordinates are whole ten-thousandths, so the exact mean is integer arithmetic.
_MEAN = "CAST((2 * sum(CAST(round({c} * 10000) AS BIGINT)) * 100 + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000"
GROUPS = "SELECT state, cluster, " + _MEAN.format(c="latitude") + " AS latitude, " + _MEAN.format(c="longitude") + """ AS longitude, count(*) AS event_count, min(id) AS first_event,
    row_number() OVER (PARTITION BY state ORDER BY min(id)) AS cluster_no, count(*) OVER (PARTITION BY state) AS clusters FROM {source} GROUP BY 1, 2"""
BY_DISTRICT = """SELECT h.*, k.cluster FROM haz h JOIN (SELECT state, coalesce(district, '-') AS dis, min(id) AS cluster FROM haz WHERE state IS NOT NULL GROUP BY 1, 2) k
    ON k.state = h.state AND k.dis = coalesce(h.district, '-')"""


def by_district(dom: Domain):
    """Events labelled by state and district, so that numbering and zones have given labels."""
    named = dom.events.where("state IS NOT NULL").withColumn("_d", F.coalesce("district", F.lit("-")))
    labels = named.groupBy("state", "_d").agg(F.min("id").alias("cluster"))
    return named.join(labels, ["state", "_d"]).drop("_d")


@query("w08_cluster_numbers", "SELECT state, cluster, cluster_no, event_count FROM g", labelled=BY_DISTRICT, g=GROUPS.format(source="labelled"))
def w08(dom: Domain):
    return cluster.number_clusters(by_district(dom)).select("state", "cluster", "cluster_no", "event_count")


ZONE_SQL = """SELECT CASE WHEN clusters > 1 THEN state || ' Region ' || cluster_no ELSE state END || ' (Historical Cluster)' AS name, state, latitude, longitude,
    CASE WHEN slope_degrees IS NOT NULL THEN slope_degrees ELSE 0 END AS slope, CASE WHEN slope_degrees IS NOT NULL THEN elevation_m ELSE 0 END AS elevation,
    event_count AS historical_event_count, slope_degrees IS NOT NULL AS terrain_data_real, 'UNKNOWN' AS risk_level FROM g JOIN ter ON pid = g.cluster"""
ZONE_COLUMNS = ["name", "state", "latitude", "longitude", "slope", "elevation", "historical_event_count", "terrain_data_real", "risk_level"]


@query("a16_zones_from_clusters", ZONE_SQL, labelled=BY_DISTRICT, g=GROUPS.format(source="labelled"), **terrain_views("g", "cluster"))
def a16(dom: Domain):
    return zones.zones_from_clusters(by_district(dom).select("id", "state", "latitude", "longitude", "cluster"), dem(dom)).select(*ZONE_COLUMNS)


@query("p42_zone_names", "SELECT first_event, CASE WHEN clusters > 1 THEN state || ' Region ' || cluster_no ELSE state END || ' (Historical Cluster)' AS name FROM g",
       labelled=BY_DISTRICT, g=GROUPS.format(source="labelled"))
def p42(dom: Domain):
    groups = cluster.number_clusters(by_district(dom))
    counts = groups.groupBy("state").agg(F.count("*").alias("clusters"))
    return groups.join(counts, "state").select("first_event", zones.zone_name(F.col("state"), F.col("cluster_no"), F.col("clusters")).alias("name"))


@query("z04_derived_zones", ZONE_SQL, **CLUSTERS, labelled="SELECT ev.*, cluster FROM ev JOIN labels USING (id)", g=GROUPS.format(source="labelled"),
       **terrain_views("g", "cluster"))
def z04(dom: Domain):
    names = dom.polygons.select(F.col("name").alias("state"))
    events = dom.events.select("id", "state", "latitude", "longitude")
    return zones.build_derived_zones(events, names, dem(dom), EPS * vocab.KM_PER_DEGREE).select(*ZONE_COLUMNS)


# Sampling --------------------------------------------------------------------------------------
CAND = """SELECT id AS point_id, 26 + CAST((id * 6007) % 20000 AS DOUBLE) / 10000 AS latitude, 88 + CAST((id * 48611) % 20000 AS DOUBLE) / 10000 AS longitude FROM zones"""


@query("a18_rejections_per_stage", """SELECT stage, count(*) AS attempts FROM (SELECT CASE WHEN f.name IS NULL OR f.name = '' THEN 'outside_boundary' WHEN near THEN 'buffer'
    WHEN NOT terrain_available THEN 'no_terrain' WHEN raw_class IS NULL THEN 'no_landcover' ELSE 'passed' END AS stage FROM cand LEFT JOIN first_hit f ON f.id = cand.point_id
    JOIN buf USING (point_id) JOIN ter ON pid = cand.point_id JOIN cover USING (point_id)) GROUP BY 1""", cand=CAND,
       crossings=CONTAINED["crossings"].replace("FROM haz p", "FROM (SELECT point_id AS id, latitude, longitude FROM cand) p"), hits=CONTAINED["hits"], first_hit=CONTAINED["first_hit"],
       buf=f"""SELECT point_id, EXISTS (SELECT 1 FROM haz e WHERE e.latitude BETWEEN cand.latitude - {d(0.03)} AND cand.latitude + {d(0.03)}
         AND {hav('cand.latitude', 'cand.longitude', 'e.latitude', 'e.longitude')} <= {d(0.7)}) AS near FROM cand""",
       **terrain_views("cand", "point_id"), pxl=pixel_view("cand", "lc_tiles"),
       cover=feature_views(POINTS)["cover"])
def a18(dom: Domain):
    tried = given_negatives(dom).drop("as_of")
    judged = sampling.stage(tried, dom.events, dem(dom), landcover(dom), regions=dom.polygons, buffer_km=0.7)
    return judged.groupBy(F.coalesce("rejected_by", F.lit("passed")).alias("stage")).agg(F.count("*").alias("attempts"))


def negatives(dom: Domain):
    # The events of the test tables stand about half a kilometre apart, hence the small buffer.
    return susceptibility.sample_negatives(dom.events, BOX, dem(dom), landcover(dom), dom.polygons, ratio=1, buffer_km=0.4)


@query("c02_candidates")
def c02(dom: Domain):
    """One candidate per event, dated inside the events' own range."""
    span = dom.events.agg(F.count("*").alias("n"), F.min("event_date").alias("a"), F.datediff(F.max("event_date"), F.min("event_date")).alias("days")).first()
    return sampling.candidates(dom.spark, 0, span["n"], BOX, span["a"], span["days"], 42)


@query("c03_pseudo_absences")
def c03(dom: Domain):
    return negatives(dom)[0]


@query("w07_quota_outcomes")
def w07(dom: Domain):
    return negatives(dom)[1]


# Model -----------------------------------------------------------------------------------------

def dataset(dom: Domain) -> susceptibility.Dataset:
    """The dataset job over the box."""
    return susceptibility.build_dataset(dom.events, dom.rainfall, dem(dom), landcover(dom), BOX, work_path(dom.spark, "training"), dom.polygons,
                                        ratio=1, buffer_km=0.4)


def training(dom: Domain):
    """Labelled features of the box's events and of negatives drawn in it, complete rows only."""
    return dataset(dom).rows


@query("c03_sampling_report")
def c03_report(dom: Domain):
    """Requested and accepted negatives, the shortfall, and the attempts per outcome."""
    return dataset(dom).sampling


@query("c05_dataset_job", f"""SELECT label, rainfall_30d, elevation_m, historical_landslide_count FROM feat WHERE {CRITICAL}""",
       **feature_views("""SELECT 'event_' || id AS point_id, latitude, longitude, coalesce(event_date, created_at) AS as_of, 1 AS label FROM haz
           WHERE latitude BETWEEN 26 AND 28 AND longitude BETWEEN 88 AND 90"""))
def c05_job(dom: Domain):
    """The positives of the whole job, which are those of the box; its negatives are drawn at random."""
    return dataset(dom).rows.where("label = 1").select("label", "rainfall_30d", "elevation_m", "historical_landslide_count")


def fitted(dom: Domain, with_density: bool):
    return susceptibility.train(training(dom), with_density)


def scored(dom: Domain):
    """The training rows scored by the model fitted on them; the dataset job runs once."""
    rows = training(dom)
    return model.score_points(susceptibility.train(rows, True)[0], rows)


@query("p25_feature_vector")
def p25(dom: Domain):
    names = features.feature_names()
    rows = features.encoded(training(dom))
    vector = VectorAssembler(inputCols=names, outputCol="vector", handleInvalid="error").transform(rows)
    return vector.select("point_id", "label", *[F.get(vector_to_array("vector"), F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("m01_train_susceptibility")
def m01(dom: Domain):
    return fitted(dom, True)[1]


@query("m02_train_without_density")
def m02(dom: Domain):
    return fitted(dom, False)[1]


@query("m03_score_points")
def m03(dom: Domain):
    return scored(dom)


@query("m04_feature_importance")
def m04(dom: Domain):
    values = model.importances(fitted(dom, True)[0], features.feature_names())
    return dom.spark.createDataFrame(values, "feature STRING, importance DOUBLE")


@query("p43_susceptibility_score")
def p43(dom: Domain):
    return scored(dom).select("point_id", "susceptibility_score", "available")


@query("m05_risk_classifier")
def m05(dom: Domain):
    """Zones labelled by the rules; the held-back fifth of every class is scored by the model, the rest by the rules."""
    from talus.functions import risk
    from talus.operators import scoring

    factors = risk.factor_columns({c: F.col(c) for c in scoring.ENVIRONMENT})
    labelled = model.risk_rows(dom.zones.withColumn("risk_level", risk.level(risk.total_score(factors))).select("id", "risk_level", *vocab.RISK_MODEL_FEATURES))
    split = model.stratified_split(labelled, "risk_level", "id")
    forest = model.fit_risk(split.where("is_train"))
    scores = model.predict_risk(forest, split.where("NOT is_train"))
    return scoring.score_zones(dom.zones, scores).select("id", "risk_score", "risk_level", "prediction_source")
