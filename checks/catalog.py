"""Every registered query: the Spark callable and, where SQL can say it, the DuckDB statement."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from hearthgrid import config
from hearthgrid.functions import crs, geometry as g
from hearthgrid.layer import require_columns
from hearthgrid.models import estimators as est
from hearthgrid.models.lasso import choose_penalty
from hearthgrid.models.registry import ModelRegistry, params_hash_expr
from hearthgrid.models.registry import params_hash as params_hash_of
from hearthgrid.operators import areas as ar
from hearthgrid.operators import columns as c
from hearthgrid.operators import metrics as m
from hearthgrid.operators import neighbours as nb
from hearthgrid.operators import prep
from hearthgrid.operators import profile as pf
from hearthgrid.operators.raster import Raster, pixels_of, sample, to_tiles
from hearthgrid.operators.spatial_join import nearest_left, points_within, polygons_at
from hearthgrid.operators.cells import explode_edges
from hearthgrid.plans.building_features import building_features
from hearthgrid.plans.clean_attributes import clean_attributes, target_report
from hearthgrid.plans.train_compare import score_models, train_and_compare, train_models
from hearthgrid.session import materialize, scratch_path
from hearthgrid.sources import geojson, sinks, tables

QUERIES = {}
ORACLES = {}


def query(name, sql=None, needs=()):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = (fx.with_clause(*needs) if needs else "") + sql.strip()
        return fn
    return add


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def raster(spark, sf):
    return Raster(fx.view(spark, sf, "fx_pixels"), **fx.RASTER)


def tiles(spark, sf):
    """The raster in blocks, written and read again."""
    path, blocks = scratch_path(spark, "tiles"), to_tiles(raster(spark, sf))
    tables.write_tiles(blocks, path)
    return tables.read_tiles(spark, path, blocks.side, blocks.x0, blocks.y0, blocks.dx, blocks.dy)


POI_TYPES = ["high", "low", "medium", "not_specified", "urgent"]
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
# Point to segment, in the terms of a (x, y) and r (x1, y1, x2, y2).
_T = """least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce(
        ((a.x - r.x1) * (r.x2 - r.x1) + (a.y - r.y1) * (r.y2 - r.y1))
        / nullif((r.x2 - r.x1) * (r.x2 - r.x1) + (r.y2 - r.y1) * (r.y2 - r.y1), CAST(0 AS DOUBLE)), CAST(0 AS DOUBLE))))"""
SEG = f"""sqrt((a.x - (r.x1 + {_T} * (r.x2 - r.x1))) * (a.x - (r.x1 + {_T} * (r.x2 - r.x1)))
        + (a.y - (r.y1 + {_T} * (r.y2 - r.y1))) * (a.y - (r.y1 + {_T} * (r.y2 - r.y1))))"""
_BX = "greatest(w.xmin - a.x, a.x - w.xmax, CAST(0 AS DOUBLE))"
_BY = "greatest(w.ymin - a.y, a.y - w.ymax, CAST(0 AS DOUBLE))"
BOX = f"sqrt({_BX} * {_BX} + {_BY} * {_BY})"
INF = "CAST('Infinity' AS DOUBLE)"

# --- sources and sinks ----------------------------------------------------------------


@query("scan_feature_table", "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders")
def scan_feature_table(spark, sf):
    df = tables.read_table(spark, f"{sf}/orders.parquet")
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("scan_geojson", "SELECT building_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM fx_buildings",
       ["fx_buildings"])
def scan_geojson(spark, sf):
    path = scratch_path(spark, "buildings")
    geojson.write_geojson(fx.building_points(spark, sf), path)
    read = geojson.read_geojson_layer(spark, path, "building_id", "point")
    return rounded(read.located(names=("lon", "lat")), 9, "lon", "lat")


@query("scan_geojson_collection",
       "SELECT building_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM fx_buildings", ["fx_buildings"])
def scan_geojson_collection(spark, sf):
    """Collections of a hundred features on a line each."""
    path, layer = scratch_path(spark, "collections"), fx.building_points(spark, sf)
    lines = geojson.to_features(layer).withColumn("k", F.get_json_object("value", "$.properties.building_id").cast("long"))
    body = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("value"), ", "), F.lit("]}"))
    lines.groupBy(F.expr("k DIV 100")).agg(body.alias("value")).select("value").write.text(path)
    read = geojson.read_geojson_layer(spark, path, "building_id", "point")
    return rounded(read.located(names=("lon", "lat")), 9, "lon", "lat")


ODD_NAMES = {"high": "bus stop", "low": "v1.2", "medium": "Shop", "not_specified": "shop", "urgent": "100%+"}
def document_range_bytes(spark, path):
    """Bytes of a range: small ones cut a small document too; a large one is cut into about 256, and none is above 128 MB."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return min(128 << 20, max(32 << 10, -(-size // 256)))


@query("scan_geojson_document", "SELECT building_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM fx_buildings", ["fx_buildings"])
def scan_geojson_document(spark, sf):
    """One document on a single line, cut into byte ranges that several tasks read."""
    path, layer = scratch_path(spark, "document"), fx.building_points(spark, sf)
    features = geojson.to_features(layer.to_srid(4326)).select(F.concat(F.col("value"), F.lit(",")).alias("value"))
    ends = [f'{{"type": "FeatureCollection", "name": "a }} \\"b", "features": [', '{"type": "Note"}]}']
    head, tail = (spark.createDataFrame([(e,)], "value string") for e in ends)
    whole = head.withColumn("k", F.lit(0)).unionByName(features.withColumn("k", F.lit(1))).unionByName(tail.withColumn("k", F.lit(2)))
    whole.orderBy("k").select("value").coalesce(1).write.option("lineSep", " ").text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(document_range_bytes(spark, path)))
    try:
        read = geojson.read_geojson_layer(spark, path, "building_id", "point", collection="ranges")
        return rounded(materialize(read.located(names=("lon", "lat")), "read"), 9, "lon", "lat")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


ODD_SQL = "CASE poi_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ODD_NAMES.items()) + " END"


@query("scan_poi_odd_names", f"SELECT poi_id, {ODD_SQL} AS poi_type FROM fx_pois", ["fx_pois"])
def scan_poi_odd_names(spark, sf):
    folder, pois = scratch_path(spark, "odd"), fx.pois(spark, sf)
    for kind, name in ODD_NAMES.items():
        one = c.by_type(pois, kind)
        geojson.write_geojson(one.with_df(one.df.drop("poi_type")), f"{folder}/{name}.geojson")
    return geojson.read_poi_folder(spark, folder).df.select("poi_id", "poi_type")


@query("scan_poi_dir", "SELECT poi_id, poi_type, round(lon, 9) AS lon, round(lat, 9) AS lat FROM fx_pois",
       ["fx_pois"])
def scan_poi_dir(spark, sf):
    folder, pois = scratch_path(spark, "pois"), fx.pois(spark, sf)
    for kind in nb.poi_types(pois.df):
        one = c.by_type(pois, kind)
        geojson.write_geojson(one.with_df(one.df.drop("poi_type")), f"{folder}/{kind}.geojson")
    read = geojson.read_poi_folder(spark, folder)
    return rounded(read.located("poi_type", names=("lon", "lat")), 9, "lon", "lat")


@query("scan_layer", "SELECT * FROM customer")
def scan_layer(spark, sf):
    df = tables.read_table(spark, f"{sf}/customer.parquet")
    return require_columns(df, ["c_custkey", "c_name", "c_nationkey"])


@query("scan_raster", "SELECT row_idx, col_idx, value FROM fx_pixels", ["fx_pixels"])
def scan_raster(spark, sf):
    path = scratch_path(spark, "pixels")
    sinks.write_table(fx.view(spark, sf, "fx_pixels"), path)
    return tables.read_raster(spark, path, **fx.RASTER).pixels


@query("scan_raster_tiles", "SELECT row_idx, col_idx, max(value) AS value FROM fx_pixels WHERE value <> -99999 GROUP BY 1, 2", ["fx_pixels"])
def scan_raster_tiles(spark, sf):
    return pixels_of(tiles(spark, sf))


@query("sink_parquet_roundtrip", "SELECT poi_id, poi_type, lon, lat FROM fx_pois", ["fx_pois"])
def sink_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "all-poi")
    sinks.write_table(fx.view(spark, sf, "fx_pois").select("poi_id", "poi_type", "lon", "lat"), path)
    return rounded(tables.read_table(spark, path), 12)


@query("sink_geojson", """
SELECT water_id, round((xmin + xmax) / 2, 3) AS x, round((ymin + ymax) / 2, 3) AS y FROM fx_water""", ["fx_water"])
def sink_geojson(spark, sf):
    path = scratch_path(spark, "water")
    geojson.write_geojson(fx.water(spark, sf), path)
    read = geojson.read_geojson_layer(spark, path, "water_id", "polygon")
    return rounded(read.located(srid=3857), 3, "x", "y")


@query("sink_predictions", """
SELECT model, id, y_true, y_pred, y_pred - y_true AS error FROM fx_predictions""", ["fx_predictions"])
def sink_predictions(spark, sf):
    path = scratch_path(spark, "results")
    sinks.write_predictions(fx.view(spark, sf, "fx_predictions"), path)
    return tables.read_table(spark, f"{path}/predictions").select("model", "id", "y_true", "y_pred", "error")


@query("file_catalog", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', "
       "'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS stem, true AS has_bytes, true AS in_folder")
def file_catalog(spark, sf):
    """Name, whether there is anything in it, and whether its folder is the one asked for."""
    here = sf.rstrip("/").rsplit("/", 1)[-1]
    return tables.file_catalog(spark, sf, ".parquet") \
        .select("stem", (F.col("length") > 0).alias("has_bytes"), F.col("folder").endswith(here).alias("in_folder"))


# --- projections, filters, predicates ----------------------------------------------------


@query("drop_leak_columns", """
SELECT id, peopleCount, t_int, t_int_null, t_blank, t_mixed, t_suffix, t_label, t_allnull, n_price
FROM fx_attributes""", ["fx_attributes"])
def drop_leak_columns(spark, sf):
    return c.drop_leaks(fx.view(spark, sf, "fx_attributes"))


@query("drop_strict", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_strict(spark, sf):
    return c.drop_required(fx.table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@query("rename_area_columns", """
SELECT objectid AS "area_OBJECTID", fname AS "area_FNAME", eng_name AS "area_Eng_Name" FROM fx_areas""", ["fx_areas"])
def rename_area_columns(spark, sf):
    return ar.rename_areas(fx.areas(spark, sf).df).drop("shape")


@query("select_area_columns", 'SELECT objectid AS "OBJECTID", fname AS "FNAME" FROM fx_areas', ["fx_areas"])
def select_area_columns(spark, sf):
    return fx.areas(spark, sf).df.select("OBJECTID", "FNAME")


@query("default_columns", f"""
SELECT building_id, CAST(0 AS BIGINT) AS count_water, {INF} AS nearest_water_dist FROM fx_buildings""", ["fx_buildings"])
def default_columns(spark, sf):
    return fx.buildings(spark, sf).df.select(
        "building_id", F.lit(0).cast("bigint").alias("count_water"),
        F.lit(nb.INFINITY).alias("nearest_water_dist"))


@query("roads_positive_width", "SELECT road_id, fwidth FROM fx_roads WHERE fwidth > 0", ["fx_roads"])
def roads_positive_width(spark, sf):
    return nb.usable_roads(fx.roads(spark, sf)).df.select("road_id", F.col("FWIDTH").alias("fwidth"))


@query("poi_by_type", "SELECT poi_id, poi_type FROM fx_pois WHERE poi_type = 'urgent'", ["fx_pois"])
def poi_by_type(spark, sf):
    return c.by_type(fx.pois(spark, sf), "urgent").df.select("poi_id", "poi_type")


@query("quantile_filter", """
SELECT id, peopleCount FROM fx_attributes
WHERE peopleCount <= (SELECT quantile_cont(CAST(peopleCount AS DOUBLE), 0.99) FROM fx_attributes)""", ["fx_attributes"])
def quantile_filter(spark, sf):
    return c.at_most_quantile(fx.view(spark, sf, "fx_attributes").select("id", "peopleCount"))


@query("quantile_report", """
SELECT count(*) AS n_rows, round(max(q.v), 6) AS quantile,
       CAST(sum(CASE WHEN peopleCount <= q.v THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
FROM fx_attributes, (SELECT quantile_cont(CAST(peopleCount AS DOUBLE), 0.99) AS v FROM fx_attributes) q""", ["fx_attributes"])
def quantile_report(spark, sf):
    return rounded(target_report(fx.view(spark, sf, "fx_attributes")), 6, "quantile")


@query("fill_defaults", f"""
SELECT r.id, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.max_price, {INF}) AS max_price,
       coalesce(r.t_label, 'MISSING') AS t_label
FROM fx_attributes r LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, max(l_extendedprice) AS max_price
     FROM lineitem GROUP BY l_orderkey) f ON r.id = f.l_orderkey""", ["fx_attributes"])
def fill_defaults(spark, sf):
    lines = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")) \
        .agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_extendedprice").alias("max_price"))
    rows = fx.view(spark, sf, "fx_attributes").select("id", "t_label").join(lines, "id", "left")
    return c.fill(rows, ["n_lines"], ["max_price"], ["t_label"], config.MISSING_LABEL)


FEATURES = ["f_price", "f_lines", "f_qty", "f_max_price", "f_noise", "f_const"]


def _clean_sql(v):
    return f"CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN CAST(0 AS DOUBLE) ELSE {v} END"


@query("clean_non_finite", f"""
SELECT id, {', '.join(f'{_clean_sql(f)} AS {f}' for f in FEATURES)} FROM fx_features""", ["fx_features"])
def clean_non_finite(spark, sf):
    return c.clean_non_finite(fx.view(spark, sf, "fx_features").drop("peopleCount"), FEATURES)


@query("feature_target_split", """
SELECT id, peopleCount AS target, f_lines, f_qty, f_max_price, f_noise, f_const, CAST(6 AS BIGINT) AS n_features
FROM fx_features""", ["fx_features"])
def feature_target_split(spark, sf):
    df = fx.view(spark, sf, "fx_features")
    names = c.feature_names(df.drop("id"))
    return df.select("id", F.col(config.TARGET).alias("target"), *names[1:],
                     F.lit(len(names)).cast("bigint").alias("n_features"))


# --- geometry ----------------------------------------------------------------------------


@query("building_centroid", "SELECT building_id, round(x, 3) AS x, round(y, 3) AS y FROM fx_buildings", ["fx_buildings"])
def building_centroid(spark, sf):
    return rounded(fx.buildings(spark, sf).located(), 3, "x", "y")


@query("building_inner_point", "SELECT building_id, round(x, 3) AS x, round(y, 3) AS y FROM fx_buildings", ["fx_buildings"])
def building_inner_point(spark, sf):
    return rounded(fx.buildings(spark, sf).located(inner=True), 3, "x", "y")


@query("road_centroid", """
SELECT road_id, round((x1 + x2) / 2, 3) AS x, round((y1 + y2) / 2, 3) AS y FROM fx_roads""", ["fx_roads"])
def road_centroid(spark, sf):
    return rounded(fx.roads(spark, sf).located(), 3, "x", "y")


@query("reproject_mercator", """
SELECT building_id, round(x, 3) AS x, round(y, 3) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat
FROM fx_buildings""", ["fx_buildings"])
def reproject_mercator(spark, sf):
    there = fx.building_points(spark, sf).projected()
    lon, lat = crs.from_mercator("spot.x", "spot.y")
    return rounded(there.df.selectExpr("building_id", "spot.x AS x", "spot.y AS y",
                                       f"{lon} AS lon", f"{lat} AS lat"), 3, "x", "y") \
        .transform(rounded, 9, "lon", "lat")


@query("utm_zone", """
SELECT building_id, CAST(greatest(1, least(60, floor((lon + 180) / 6) + 1)) AS BIGINT) AS zone,
       CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + greatest(1, least(60, floor((lon + 180) / 6) + 1)) AS BIGINT) AS srid
FROM fx_buildings""", ["fx_buildings"])
def utm_zone(spark, sf):
    spots = fx.building_points(spark, sf).located(names=("lon", "lat"))
    return spots.selectExpr("building_id", f"{crs.utm_zone('lon')} AS zone", f"{crs.utm_srid('lon', 'lat')} AS srid")


def _utm_sql():
    """Transverse Mercator by the published series in the third flattening, zone 50 north."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    ecc, rect = 2 * n ** 0.5 / (1 + n), 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    a = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
         13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
         61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280]
    d = "CAST({!r} AS DOUBLE)".format
    east = " + ".join(f"{d(v)} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, v in enumerate(a, 1))
    north = " + ".join(f"{d(v)} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, v in enumerate(a, 1))
    return f"""
, p AS (SELECT building_id, radians(lon) - radians({d(117.0)}) AS lam, sin(radians(lat)) AS s FROM fx_buildings),
t AS (SELECT building_id, lam, sinh(atanh(s) - {d(ecc)} * atanh({d(ecc)} * s)) AS t FROM p),
u AS (SELECT building_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT building_id, round({d(500000.0)} + {d(0.9996 * rect)} * (eta + {east}), 3) AS x,
       round({d(0.9996 * rect)} * (xi + {north}), 3) AS y FROM u"""


UTM_SQL = _utm_sql()


@query("utm_reproject", UTM_SQL, ["fx_buildings"])
def utm_reproject(spark, sf):
    points = fx.building_points(spark, sf)
    return rounded(points.to_srid(ar.layer_utm(points)).located(), 3, "x", "y")


@query("point_segment_distance", f"""
SELECT a.building_id, round({SEG}, 3) AS dist FROM fx_buildings a JOIN fx_roads r ON a.building_id = r.road_id""",
       ["fx_buildings", "fx_roads"])
def point_segment_distance(spark, sf):
    spots = fx.buildings(spark, sf).located()
    edges = explode_edges(fx.roads(spark, sf)).withColumnRenamed("road_id", "building_id")
    near = g.segment_distance("x", "y", *g.EDGE)
    return rounded(spots.join(edges, "building_id").selectExpr("building_id", f"{near} AS dist"), 3, "dist")


@query("point_polygon_distance", f"""
SELECT a.building_id, round({BOX}, 3) AS dist FROM fx_buildings a JOIN fx_water w ON a.building_id = w.water_id""",
       ["fx_buildings", "fx_water"])
def point_polygon_distance(spark, sf):
    water = fx.water(spark, sf)
    pairs = fx.buildings(spark, sf).located().join(
        water.df.withColumnRenamed("water_id", "building_id"), "building_id")
    near = g.point_geometry_distance("x", "y", "array(shape)", "polygon")
    return rounded(pairs.selectExpr("building_id", f"{near} AS dist"), 3, "dist")


@query("point_in_polygon", """
SELECT building_id, true AS centre_inside, false AS corner_inside FROM fx_buildings""", ["fx_buildings"])
def point_in_polygon(spark, sf):
    layer = fx.buildings(spark, sf)
    spots = layer.df.join(layer.located(), "building_id")
    corner = ("footprint[0][0].x", "footprint[0][0].y")
    return spots.selectExpr("building_id",
                            f"{g.point_in_polygon('x', 'y', layer.multi())} AS centre_inside",
                            f"{g.point_in_polygon(*corner, layer.multi())} AS corner_inside")


_R = {k: f"CAST({v} AS DOUBLE)" for k, v in
      fx.RASTER.items() if k != "nodata"}
PIXEL = (f"CAST(floor(({_R['y0']} - lat) / {_R['dy']}) AS BIGINT)", f"CAST(floor((lon - {_R['x0']}) / {_R['dx']}) AS BIGINT)")


@query("pixel_index", f"SELECT building_id, {PIXEL[0]} AS row_idx, {PIXEL[1]} AS col_idx FROM fx_buildings", ["fx_buildings"])
def pixel_index(spark, sf):
    row, col = raster(spark, sf).index("lon", "lat")
    spots = fx.building_points(spark, sf).located(names=("lon", "lat"))
    return spots.selectExpr("building_id", f"{row} AS row_idx", f"{col} AS col_idx")


# --- joins -------------------------------------------------------------------------------

IN_AREA = "p.lon > a.lon_min AND p.lon < a.lon_max AND p.lat > a.lat_min AND p.lat < a.lat_max"


@query("poi_in_area", f"""
SELECT p.poi_id, p.poi_type, round(p.lon, 9) AS lon, round(p.lat, 9) AS lat
FROM fx_pois p JOIN fx_areas a ON {IN_AREA}""", ["fx_pois", "fx_areas"])
def poi_in_area(spark, sf):
    found = ar.points_in_areas(fx.pois(spark, sf), fx.areas(spark, sf))
    return rounded(found.selectExpr("poi_id", "poi_type", "spot.x AS lon", "spot.y AS lat"), 9, "lon", "lat")


@query("building_area_left", f"""
SELECT p.building_id, a.objectid AS "area_OBJECTID", a.fname AS "area_FNAME", a.eng_name AS "area_Eng_Name"
FROM fx_buildings p LEFT JOIN fx_areas a ON {IN_AREA}""", ["fx_buildings", "fx_areas"])
def building_area_left(spark, sf):
    """Footprints: their centroids are taken in a UTM zone."""
    return ar.area_features(fx.buildings(spark, sf), fx.areas(spark, sf)).drop("footprint")


ORACLES["building_area_left_points"] = ORACLES["building_area_left"]


@query("building_area_left_points")
def building_area_left_points(spark, sf):
    return ar.area_features(fx.building_points(spark, sf), fx.areas(spark, sf)).drop("spot")


@query("poi_within_radius", f"""
SELECT b.poi_id, a.building_id, round({DIST}, 3) AS dist
FROM fx_buildings a JOIN fx_pois b ON b.x BETWEEN a.x - 500 AND a.x + 500 AND b.y BETWEEN a.y - 500 AND a.y + 500
WHERE {DIST} < 500""", ["fx_buildings", "fx_pois"])
def poi_within_radius(spark, sf):
    spots = fx.buildings(spark, sf).located()
    pois = fx.pois(spark, sf).projected().located(names=("ox", "oy"))
    return rounded(points_within(spots, pois, 500.0).select("poi_id", "building_id", "dist"), 3, "dist")


@query("water_within_radius", f"""
SELECT a.building_id, w.water_id FROM fx_buildings a JOIN fx_water w
ON a.x BETWEEN w.xmin - 500 AND w.xmax + 500 AND a.y BETWEEN w.ymin - 500 AND w.ymax + 500
WHERE {BOX} <= 500""", ["fx_buildings", "fx_water"])
def water_within_radius(spark, sf):
    spots = fx.buildings(spark, sf).located(inner=True)
    return polygons_at(spots, ["building_id"], fx.water(spark, sf), 500.0).select("building_id", "water_id")


USED_ROADS = "SELECT * FROM fx_roads WHERE fwidth > 0"
NEAR_ROADS = f"""
, near AS (SELECT a.building_id, r.road_id, {SEG} AS dist FROM fx_buildings a JOIN ({USED_ROADS}) r
   ON a.x BETWEEN least(r.x1, r.x2) - 500 AND greatest(r.x1, r.x2) + 500
   AND a.y BETWEEN least(r.y1, r.y2) - 500 AND greatest(r.y1, r.y2) + 500 WHERE {SEG} <= 500),
tied AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY building_id ORDER BY dist) AS place FROM near) n WHERE place = 1)"""


@query("road_nearest_left", f"""{NEAR_ROADS}
SELECT b.building_id, t.road_id, round(t.dist, 3) AS dist FROM fx_buildings b LEFT JOIN tied t ON b.building_id = t.building_id""",
       ["fx_buildings", "fx_roads"])
def road_nearest_left(spark, sf):
    spots = fx.buildings(spark, sf).located()
    edges = explode_edges(nb.usable_roads(fx.roads(spark, sf)))
    found = nearest_left(spots, ["building_id"], edges, "road_id", 500.0)
    return rounded(found.select("building_id", "road_id", "dist"), 3, "dist")


NEAR_CENTRES = f"""
, centres AS (SELECT water_id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM fx_water),
centre_dist AS (SELECT a.building_id, min({DIST}) AS dist FROM fx_buildings a JOIN centres b
   ON b.x BETWEEN a.x - 600 AND a.x + 600 AND b.y BETWEEN a.y - 600 AND a.y + 600 WHERE {DIST} < 600 GROUP BY a.building_id)"""


@query("water_nearest", f"""{NEAR_CENTRES}
SELECT b.building_id, coalesce(round(d.dist, 3), {INF}) AS nearest_water_dist
FROM fx_buildings b LEFT JOIN centre_dist d ON b.building_id = d.building_id""", ["fx_buildings", "fx_water"])
def water_nearest(spark, sf):
    located, spots = nb.with_places(fx.buildings(spark, sf), inner=True)
    near = nb.at_places(nb.water_centre_distance(spots, fx.water(spark, sf), config.WATER_RADIUS), spots)
    out = located.join(near, nb.XY, "left").select("building_id", "nearest_water_dist")
    return rounded(out, 3, "nearest_water_dist").fillna(nb.INFINITY, ["nearest_water_dist"])


POPULATION = f"""
, population AS (SELECT b.building_id, CASE WHEN p.value IS NULL OR p.value = -99999 THEN CAST(0 AS DOUBLE) ELSE p.value END AS population
   FROM (SELECT building_id, {PIXEL[0]} AS row_idx, {PIXEL[1]} AS col_idx FROM fx_buildings) b
   LEFT JOIN fx_pixels p ON b.row_idx = p.row_idx AND b.col_idx = p.col_idx)"""


@query("population_sample", f"{POPULATION} SELECT building_id, population FROM population", ["fx_buildings", "fx_pixels"])
def population_sample(spark, sf):
    return sample(fx.buildings(spark, sf), tiles(spark, sf)).select("building_id", "population")


ORACLES["population_sample_pixels"] = ORACLES["population_sample"]


@query("population_sample_pixels")
def population_sample_pixels(spark, sf):
    return sample(fx.buildings(spark, sf), raster(spark, sf)).select("building_id", "population")


@query("lookup_with_default", """
SELECT c.c_custkey, c.c_name, coalesce(o.n_orders, 0) AS n_orders FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")
def lookup_with_default(spark, sf):
    counts = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")) \
        .agg(F.count(F.lit(1)).alias("n_orders"))
    customers = fx.table(spark, sf, "customer").select("c_custkey", "c_name")
    return c.lookup(customers, counts, "c_custkey", "n_orders", 0)


# --- aggregations ---------------------------------------------------------------------------

WATER_COUNTS = f"""
, water_counts AS (SELECT a.building_id, count(*) AS n FROM fx_buildings a JOIN fx_water w
   ON a.x BETWEEN w.xmin - 500 AND w.xmax + 500 AND a.y BETWEEN w.ymin - 500 AND w.ymax + 500
   WHERE {BOX} <= 500 GROUP BY a.building_id)"""


@query("water_count", f"{WATER_COUNTS} SELECT building_id, n AS count_water FROM water_counts", ["fx_buildings", "fx_water"])
def water_count(spark, sf):
    spots = fx.buildings(spark, sf).located(inner=True)
    met = polygons_at(spots, ["building_id"], fx.water(spark, sf), 500.0)
    return met.groupBy("building_id").agg(F.count(F.lit(1)).alias("count_water"))


@query("road_nearest_dist", f"""{NEAR_ROADS}
SELECT building_id, round(min(dist), 3) AS nearest_road_dist FROM near GROUP BY building_id""", ["fx_buildings", "fx_roads"])
def road_nearest_dist(spark, sf):
    located, spots = nb.with_places(fx.buildings(spark, sf))
    near = nb.at_places(nb.road_by_place(spots, fx.roads(spark, sf), config.ROAD_RADIUS), spots)
    return rounded(located.join(near, nb.XY).select("building_id", "nearest_road_dist"), 3, "nearest_road_dist")


NEAR_POIS = f"""
, poi_near AS (SELECT a.building_id, b.poi_type, {DIST} AS dist FROM fx_buildings a JOIN fx_pois b
   ON b.x BETWEEN a.x - 500 AND a.x + 500 AND b.y BETWEEN a.y - 500 AND a.y + 500 WHERE {DIST} < 500),
poi_wide AS (SELECT building_id, {', '.join(
    f"count(*) FILTER (WHERE poi_type = '{t}') AS count_{t}, round(min(dist) FILTER (WHERE poi_type = '{t}'), 3) AS nearest_{t}_dist"
    for t in POI_TYPES)} FROM poi_near GROUP BY building_id)"""
POI_COLUMNS = ", ".join(f"coalesce(p.count_{t}, 0) AS count_{t}, p.nearest_{t}_dist" for t in POI_TYPES)
POI_DISTS = [f"nearest_{t}_dist" for t in POI_TYPES]


@query("poi_features_wide", f"""{NEAR_POIS}
SELECT b.building_id, {POI_COLUMNS} FROM fx_buildings b LEFT JOIN poi_wide p ON b.building_id = p.building_id""",
       ["fx_buildings", "fx_pois"])
def poi_features_wide(spark, sf):
    out = nb.poi_features(fx.buildings(spark, sf), fx.pois(spark, sf), config.POI_RADIUS)
    return rounded(out.drop("footprint"), 3, *POI_DISTS)


# The same answers by the search for crowded cells, which a budget of one test per cell sends everything to.
ORACLES["poi_features_crowded"] = ORACLES["poi_features_wide"]


@query("poi_features_crowded")
def poi_features_crowded(spark, sf):
    out = nb.poi_features(fx.buildings(spark, sf), fx.pois(spark, sf), config.POI_RADIUS, budget=1)
    return rounded(out.drop("footprint"), 3, *POI_DISTS)


ODD_DISTS = [f"nearest_{n}_dist" for n in nb.poi_names(sorted(ODD_NAMES.values())).values()]
ODD_COLUMNS = ", ".join(
    f'count_{k} AS "count_{n}", nearest_{k}_dist AS "nearest_{n}_dist"' for k, n in
    ((k, nb.poi_names(sorted(ODD_NAMES.values()))[v]) for k, v in ODD_NAMES.items()))


@query("poi_features_odd_types", f"""{NEAR_POIS}
SELECT building_id, {ODD_COLUMNS} FROM (
  SELECT b.building_id, {POI_COLUMNS} FROM fx_buildings b LEFT JOIN poi_wide p ON b.building_id = p.building_id) wide""",
       ["fx_buildings", "fx_pois"])
def poi_features_odd_types(spark, sf):
    pois = fx.pois(spark, sf)
    odd = pois.with_df(pois.df.withColumn("poi_type", F.expr(ODD_SQL)))
    out = nb.poi_features(fx.buildings(spark, sf), odd, config.POI_RADIUS).drop("footprint")
    return out.withColumns({d: F.round(F.col(f"`{d}`"), 3) for d in ODD_DISTS})


_FAR = "greatest(abs(w.xmin - a.x), abs(w.xmax - a.x))", "greatest(abs(w.ymin - a.y), abs(w.ymax - a.y))"


@query("poi_shapes_wide", f"""
, met AS (SELECT a.building_id, count(*) AS n, min({BOX}) AS dist FROM fx_buildings a JOIN fx_water w
   ON a.x BETWEEN w.xmin - 500 AND w.xmax + 500 AND a.y BETWEEN w.ymin - 500 AND w.ymax + 500
   WHERE sqrt({_FAR[0]} * {_FAR[0]} + {_FAR[1]} * {_FAR[1]}) < 500 GROUP BY a.building_id)
SELECT b.building_id, coalesce(m.n, 0) AS count_lake, round(m.dist, 3) AS nearest_lake_dist
FROM fx_buildings b LEFT JOIN met m ON b.building_id = m.building_id""", ["fx_buildings", "fx_water"])
def poi_shapes_wide(spark, sf):
    lakes = fx.water(spark, sf)
    lakes = lakes.with_df(lakes.df.withColumn("poi_type", F.lit("lake")))
    out = nb.poi_features(fx.buildings(spark, sf), lakes, config.POI_RADIUS)
    return rounded(out.drop("footprint"), 3, "nearest_lake_dist")


ORACLES["poi_shapes_crowded"] = ORACLES["poi_shapes_wide"]


@query("poi_shapes_crowded")
def poi_shapes_crowded(spark, sf):
    lakes = fx.water(spark, sf)
    lakes = lakes.with_df(lakes.df.withColumn("poi_type", F.lit("lake")))
    out = nb.poi_features(fx.buildings(spark, sf), lakes, config.POI_RADIUS, budget=1)
    return rounded(out.drop("footprint"), 3, "nearest_lake_dist")


_LOW, _HIGH = (f"sqrt((w.x{e} - a.x) * (w.x{e} - a.x) + (w.y{e} - a.y) * (w.y{e} - a.y))" for e in ("min", "max"))
_DIAGONAL = SEG.replace("r.x1", "w.xmin").replace("r.y1", "w.ymin").replace("r.x2", "w.xmax").replace("r.y2", "w.ymax")
MIXED_KINDS = ["lake", "pond"]
MIXED = f"""
, near AS (SELECT a.building_id, CASE WHEN w.water_id % 2 = 0 THEN 'lake' ELSE 'pond' END AS poi_type,
   CASE w.water_id % 3 WHEN 0 THEN {BOX} WHEN 1 THEN least({_LOW}, {_HIGH}) ELSE {_DIAGONAL} END AS dist
   FROM fx_buildings a JOIN fx_water w ON a.x BETWEEN w.xmin - 500 AND w.xmax + 500 AND a.y BETWEEN w.ymin - 500 AND w.ymax + 500
   WHERE CASE WHEN w.water_id % 3 = 0 THEN sqrt({_FAR[0]} * {_FAR[0]} + {_FAR[1]} * {_FAR[1]}) ELSE greatest({_LOW}, {_HIGH}) END < 500),
wide AS (SELECT building_id, {', '.join(
    f"count(*) FILTER (WHERE poi_type = '{t}') AS n_{t}, min(dist) FILTER (WHERE poi_type = '{t}') AS d_{t}" for t in MIXED_KINDS)}
   FROM near GROUP BY building_id)
SELECT b.building_id, {', '.join(f'coalesce(n_{t}, 0) AS count_{t}, round(d_{t}, 3) AS nearest_{t}_dist' for t in MIXED_KINDS)}
FROM fx_buildings b LEFT JOIN wide ON b.building_id = wide.building_id"""


@query("poi_mixed_wide", MIXED, ["fx_buildings", "fx_water"])
def poi_mixed_wide(spark, sf):
    """A folder whose files hold polygons, lines and multi-points side by side, written and read again."""
    folder, pois = scratch_path(spark, "mixed"), fx.mixed_pois(spark, sf)
    for kind in MIXED_KINDS:
        one = c.by_type(pois, kind)
        geojson.write_geojson(one.with_df(one.df.drop("poi_type")), f"{folder}/{kind}.geojson")
    out = nb.poi_features(fx.buildings(spark, sf), geojson.read_poi_folder(spark, folder), config.POI_RADIUS)
    return rounded(out.drop("footprint"), 3, *[f"nearest_{t}_dist" for t in MIXED_KINDS])


ORACLES["poi_mixed_crowded"] = ORACLES["poi_mixed_wide"]


@query("poi_mixed_crowded")
def poi_mixed_crowded(spark, sf):
    out = nb.poi_features(fx.buildings(spark, sf), fx.mixed_pois(spark, sf), config.POI_RADIUS, budget=1)
    return rounded(out.drop("footprint"), 3, *[f"nearest_{t}_dist" for t in MIXED_KINDS])


GON = "b.dist * cos(b.turn - floor(b.turn / (pi() / 32)) * (pi() / 32) - pi() / 64) < 500 * cos(pi() / 64)"


@query("poi_counts_in_polygon_buffer", f"""
, pairs AS (SELECT a.building_id, b.poi_type, {DIST} AS dist, atan2(b.y - a.y, b.x - a.x) AS turn FROM fx_buildings a JOIN fx_pois b
   ON b.x BETWEEN a.x - 500 AND a.x + 500 AND b.y BETWEEN a.y - 500 AND a.y + 500 WHERE {DIST} < 500),
n AS (SELECT building_id, {', '.join(f"count(*) FILTER (WHERE poi_type = '{t}') AS count_{t}" for t in POI_TYPES)}
   FROM pairs b WHERE {GON} GROUP BY building_id)
SELECT b.building_id, {', '.join(f'coalesce(n.count_{t}, 0) AS count_{t}' for t in POI_TYPES)}
FROM fx_buildings b LEFT JOIN n ON b.building_id = n.building_id""", ["fx_buildings", "fx_pois"])
def poi_counts_in_polygon_buffer(spark, sf):
    out = nb.poi_features(fx.buildings(spark, sf), fx.pois(spark, sf), config.POI_RADIUS, sides=config.BUFFER_SIDES)
    return out.drop("footprint", *POI_DISTS)


_CORNERS = [(f"w.{x} - a.x", f"w.{y} - a.y") for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
# A regular polygon and a box meet unless the box lies beyond one of the polygon's sides or outside its extent.
_SIDES = "generate_series(0, 63)"
_BEYOND = (f"list_max(list_transform({_SIDES}, lambda k: cos((2 * k + 1) * pi() / 64) * (CASE WHEN cos((2 * k + 1) * pi() / 64) > 0 "
           "THEN w.xmin ELSE w.xmax END - a.x) + sin((2 * k + 1) * pi() / 64) * (CASE WHEN sin((2 * k + 1) * pi() / 64) > 0 "
           "THEN w.ymin ELSE w.ymax END - a.y)))")
_CORNERS_BEYOND = "greatest(" + ", ".join(
    f"list_max(list_transform({_SIDES}, lambda k: cos((2 * k + 1) * pi() / 64) * ({x}) + sin((2 * k + 1) * pi() / 64) * ({y})))"
    for x, y in _CORNERS) + ")"


@query("water_counts_in_polygon_buffer", f"""
, met AS (SELECT a.building_id, count(*) AS n FROM fx_buildings a JOIN fx_water w
   ON a.x BETWEEN w.xmin - 500 AND w.xmax + 500 AND a.y BETWEEN w.ymin - 500 AND w.ymax + 500
   WHERE {_BEYOND} <= 500 * cos(pi() / 64) GROUP BY a.building_id)
SELECT b.building_id, coalesce(n, 0) AS count_water FROM fx_buildings b LEFT JOIN met ON b.building_id = met.building_id""",
       ["fx_buildings", "fx_water"])
def water_counts_in_polygon_buffer(spark, sf):
    out = nb.water_features(fx.buildings(spark, sf), fx.water(spark, sf), sides=config.BUFFER_SIDES)
    return out.select("building_id", "count_water")


ORACLES["water_counts_in_polygon_buffer_crowded"] = ORACLES["water_counts_in_polygon_buffer"]


@query("water_counts_in_polygon_buffer_crowded")
def water_counts_in_polygon_buffer_crowded(spark, sf):
    out = nb.water_features(fx.buildings(spark, sf), fx.water(spark, sf), sides=config.BUFFER_SIDES, budget=1)
    return out.select("building_id", "count_water")


@query("poi_shapes_in_polygon_buffer", f"""
, met AS (SELECT a.building_id, count(*) AS n FROM fx_buildings a JOIN fx_water w
   ON a.x BETWEEN w.xmin - 500 AND w.xmax + 500 AND a.y BETWEEN w.ymin - 500 AND w.ymax + 500
   WHERE {_CORNERS_BEYOND} < 500 * cos(pi() / 64) GROUP BY a.building_id)
SELECT b.building_id, coalesce(n, 0) AS count_lake FROM fx_buildings b LEFT JOIN met ON b.building_id = met.building_id""",
       ["fx_buildings", "fx_water"])
def poi_shapes_in_polygon_buffer(spark, sf):
    lakes = fx.water(spark, sf)
    lakes = lakes.with_df(lakes.df.withColumn("poi_type", F.lit("lake")))
    out = nb.poi_features(fx.buildings(spark, sf), lakes, config.POI_RADIUS, sides=config.BUFFER_SIDES)
    return out.select("building_id", "count_lake")


WATER_COLUMNS = f"coalesce(w.n, 0) AS count_water, coalesce(round(d.dist, 3), {INF}) AS nearest_water_dist"


@query("water_features", f"""{NEAR_CENTRES}{WATER_COUNTS}
SELECT b.building_id, {WATER_COLUMNS} FROM fx_buildings b
LEFT JOIN water_counts w ON b.building_id = w.building_id LEFT JOIN centre_dist d ON b.building_id = d.building_id""",
       ["fx_buildings", "fx_water"])
def water_features(spark, sf):
    out = nb.water_features(fx.buildings(spark, sf), fx.water(spark, sf))
    return rounded(out.drop("footprint"), 3, "nearest_water_dist")


ORACLES["water_features_crowded"] = ORACLES["water_features"]


@query("water_features_crowded")
def water_features_crowded(spark, sf):
    out = nb.water_features(fx.buildings(spark, sf), fx.water(spark, sf), budget=1)
    return rounded(out.drop("footprint"), 3, "nearest_water_dist")


ROADS_BY_BUILDING = f"""{NEAR_ROADS}
, road_counts AS (SELECT building_id, count(DISTINCT road_id) AS n, min(dist) AS dist FROM near GROUP BY building_id),
tie_counts AS (SELECT building_id, count(*) AS n FROM tied GROUP BY building_id)"""
ROAD_COLUMNS = f"coalesce(r.n, 0) AS count_roads, coalesce(t.n, 1) AS count_roads_tied, coalesce(round(r.dist, 3), {INF}) AS nearest_road_dist"
ROAD_JOINS = """LEFT JOIN road_counts r ON b.building_id = r.building_id LEFT JOIN tie_counts t ON b.building_id = t.building_id"""


@query("road_features_as_computed", f"""{ROADS_BY_BUILDING}
SELECT b.building_id, coalesce(t.n, 1) AS count_roads, coalesce(round(r.dist, 3), {INF}) AS nearest_road_dist
FROM fx_buildings b {ROAD_JOINS}""", ["fx_buildings", "fx_roads"])
def road_features_as_computed(spark, sf):
    out = nb.road_features(fx.buildings(spark, sf), fx.roads(spark, sf))
    return rounded(out.select("building_id", F.col("count_roads_tied").alias("count_roads"),
                              "nearest_road_dist"), 3, "nearest_road_dist")


ORACLES["road_features_crowded"] = ORACLES["road_features_as_computed"]


@query("road_features_crowded")
def road_features_crowded(spark, sf):
    out = nb.road_features(fx.buildings(spark, sf), fx.roads(spark, sf), budget=1)
    return rounded(out.select("building_id", F.col("count_roads_tied").alias("count_roads"),
                              "nearest_road_dist"), 3, "nearest_road_dist")


@query("road_features_in_radius", f"""{ROADS_BY_BUILDING}
SELECT b.building_id, coalesce(r.n, 0) AS count_roads FROM fx_buildings b {ROAD_JOINS}""", ["fx_buildings", "fx_roads"])
def road_features_in_radius(spark, sf):
    return nb.road_features(fx.buildings(spark, sf), fx.roads(spark, sf)).select("building_id", "count_roads")


@query("poi_types_distinct", "SELECT DISTINCT poi_type FROM fx_pois", ["fx_pois"])
def poi_types_distinct(spark, sf):
    return fx.pois(spark, sf).df.select("poi_type").distinct()


@query("row_count", "SELECT count(*) AS n_rows FROM fx_features", ["fx_features"])
def row_count(spark, sf):
    return pf.row_count(fx.view(spark, sf, "fx_features"))


@query("target_quantile", """
SELECT round(quantile_cont(CAST(peopleCount AS DOUBLE), 0.99), 6) AS quantile FROM fx_features""", ["fx_features"])
def target_quantile(spark, sf):
    return rounded(c.exact_quantile(fx.view(spark, sf, "fx_features")), 6, "quantile")


@query("target_stats", """
SELECT round(avg(peopleCount), 6) AS mean, min(peopleCount) AS min, max(peopleCount) AS max,
       round(stddev_pop(peopleCount), 6) AS std FROM fx_features""", ["fx_features"])
def target_stats(spark, sf):
    return rounded(prep.target_stats(fx.view(spark, sf, "fx_features")), 6, "mean", "std")


@query("regression_metrics", """
SELECT model, count(*) AS n,
       round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true) * count(*), 0), 6) AS r2,
       round(sqrt(sum((y_true - y_pred) * (y_true - y_pred)) / count(*)), 6) AS rmse,
       round(sum(abs(y_true - y_pred)) / count(*), 6) AS mae FROM fx_predictions GROUP BY model""", ["fx_predictions"])
def regression_metrics(spark, sf):
    return rounded(m.regression_metrics(fx.view(spark, sf, "fx_predictions")), 6, "r2", "rmse", "mae")


@query("layer_bounds", """
SELECT round(min(x), 3) AS x_min, round(max(x), 3) AS x_max, round(min(y), 3) AS y_min, round(max(y), 3) AS y_max
FROM fx_buildings""", ["fx_buildings"])
def layer_bounds(spark, sf):
    return rounded(ar.layer_bounds(fx.buildings(spark, sf).located()), 3, "x_min", "x_max", "y_min", "y_max")


@query("prediction_range", """
SELECT model, min(y_pred) AS pred_min, max(y_pred) AS pred_max, min(y_true) AS true_min, max(y_true) AS true_max
FROM fx_predictions GROUP BY model""", ["fx_predictions"])
def prediction_range(spark, sf):
    return m.prediction_range(fx.view(spark, sf, "fx_predictions"))


@query("hex_density", """
, box AS (SELECT model, min(y_true) AS x0, max(y_true) AS x1, min(y_pred) AS y0, max(y_pred) AS y1 FROM fx_predictions GROUP BY model),
grid AS (SELECT model, x0 - 1e-9 * (x1 - x0) AS x0, y0 - 1e-9 * (y1 - y0) AS y0,
         100 / (CASE WHEN x1 > x0 THEN (x1 - x0) * (1 + 2e-9) ELSE 1e0 END) AS fx,
         57 / (CASE WHEN y1 > y0 THEN (y1 - y0) * (1 + 2e-9) ELSE 1e0 END) AS fy FROM box),
put AS (SELECT p.model, (y_true - x0) * fx AS px, (y_pred - y0) * fy AS py FROM fx_predictions p JOIN grid g ON p.model = g.model),
two AS (SELECT *, round_even(px, 0) AS ax, round_even(py, 0) AS ay, floor(px) + 5e-1 AS bx, floor(py) + 5e-1 AS by_ FROM put),
near AS (SELECT *, (px - ax) * (px - ax) + 3 * (py - ay) * (py - ay) < (px - bx) * (px - bx) + 3 * (py - by_) * (py - by_) AS one FROM two)
SELECT model, CASE WHEN one THEN 1 ELSE 2 END AS lattice, CASE WHEN one THEN ax ELSE bx END AS hx,
       CASE WHEN one THEN ay ELSE by_ END AS hy, count(*) AS n, round(log10(count(*)), 6) AS log_n
FROM near GROUP BY ALL""", ["fx_predictions"])
def hex_density(spark, sf):
    return rounded(m.hex_density(fx.view(spark, sf, "fx_predictions")), 6, "log_n")


@query("plot_bounds", """
SELECT model, greatest(CAST(0 AS DOUBLE), least(min(y_true), min(y_pred))) AS lower, greatest(max(y_true), max(y_pred)) AS upper
FROM fx_predictions GROUP BY model""", ["fx_predictions"])
def plot_bounds(spark, sf):
    return m.plot_bounds(fx.view(spark, sf, "fx_predictions"))


PROFILED = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
            ("c_mktsegment", "string")]


@query("layer_profile", " UNION ALL ".join(f"""
SELECT CAST({i} AS INTEGER) AS position, '{n}' AS "column", '{t}' AS type, count(*) AS n_rows, count({n}) AS n_values,
       CAST(min({n}) AS VARCHAR) AS smallest, CAST(max({n}) AS VARCHAR) AS largest FROM customer"""
       for i, (n, t) in enumerate(PROFILED)))
def layer_profile(spark, sf):
    return pf.layer_profile(fx.table(spark, sf, "customer"))


# --- sort, limit, set operations ---------------------------------------------------------------


@query("head_rows", "SELECT building_id, lon, lat FROM fx_buildings ORDER BY building_id LIMIT 5", ["fx_buildings"])
def head_rows(spark, sf):
    return c.first_rows(fx.view(spark, sf, "fx_buildings").select("building_id", "lon", "lat"), "building_id")


LABELS = ["t_mixed", "t_suffix", "t_label"]
DICTIONARY = ", d AS (" + " UNION ALL ".join(f"""
SELECT '{n}' AS "column", label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT coalesce({n}, 'MISSING') AS label FROM fx_attributes) x_{n}""" for n in LABELS) + ")"


@query("label_preview", f"""{DICTIONARY} SELECT "column", label, code FROM d WHERE code < 5""", ["fx_attributes"])
def label_preview(spark, sf):
    return c.label_preview(c.label_dictionary(fx.view(spark, sf, "fx_attributes"), LABELS))


@query("union_layers", """
SELECT building_id AS id, lon, lat, CAST(NULL AS VARCHAR) AS poi_type FROM fx_buildings
UNION ALL SELECT poi_id, lon, lat, poi_type FROM fx_pois""", ["fx_buildings", "fx_pois"])
def union_layers(spark, sf):
    return c.union_layers(fx.view(spark, sf, "fx_buildings").selectExpr("building_id AS id", "lon", "lat"),
                          fx.view(spark, sf, "fx_pois").selectExpr("poi_type", "lat", "lon", "poi_id AS id"))


# --- typing, encoding, scalar functions -----------------------------------------------------------


@query("infer_numeric_columns", """
SELECT id, peopleCount, CAST(t_int AS BIGINT) AS t_int, CAST(t_int_null AS DOUBLE) AS t_int_null,
       CAST(nullif(t_blank, '') AS DOUBLE) AS t_blank, t_mixed, t_suffix, t_label,
       CAST(t_allnull AS DOUBLE) AS t_allnull, n_price FROM fx_attributes""", ["fx_attributes"])
def infer_numeric_columns(spark, sf):
    df = c.drop_leaks(fx.view(spark, sf, "fx_attributes"))
    return c.to_numeric(df, c.column_kinds(df))


@query("label_encode", f"""{DICTIONARY}
SELECT f.id, {', '.join(f'd_{n}.code AS {n}' for n in LABELS)} FROM fx_attributes f
{' '.join(f'''JOIN d d_{n} ON d_{n}."column" = '{n}' AND d_{n}.label = coalesce(f.{n}, 'MISSING')''' for n in LABELS)}""",
       ["fx_attributes"])
def label_encode(spark, sf):
    df = fx.view(spark, sf, "fx_attributes").select("id", *LABELS)
    return c.encode_labels(df, LABELS, c.label_dictionary(df, LABELS))


@query("file_stem", r"""
SELECT c_custkey, regexp_extract('data/' || c_mktsegment || '/' || c_name || '.shp', '([^/]+?)(\.[^./]*)?$', 1) AS stem,
       c_mktsegment AS folder FROM customer""")
def file_stem(spark, sf):
    paths = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat('data/', c_mktsegment, '/', c_name, '.shp') AS path")
    return paths.selectExpr("c_custkey", f"{pf.file_stem('path')} AS stem", f"{pf.parent_folder('path')} AS folder")


@query("prediction_error", "SELECT model, id, y_pred - y_true AS error FROM fx_predictions", ["fx_predictions"])
def prediction_error(spark, sf):
    return m.with_error(fx.view(spark, sf, "fx_predictions")).select("model", "id", "error")


@query("params_hash", """
SELECT p_partkey, substr(md5('p_brand=' || p_brand || ',p_size=' || CAST(p_size AS VARCHAR) || ',p_type=' || p_type), 1, 8) AS hash FROM part""")
def params_hash(spark, sf):
    asked = "map('p_size', CAST(p_size AS STRING), 'p_brand', p_brand, 'p_type', p_type)"
    return fx.table(spark, sf, "part").selectExpr("p_partkey", f"{params_hash_expr(asked)} AS hash")


# --- regression on tables ----------------------------------------------------------------------------

CLEANED = f", cleaned AS (SELECT id, CAST(peopleCount AS DOUBLE) AS y, {', '.join(f'{_clean_sql(f)} AS {f}' for f in FEATURES)} FROM fx_features)"


@query("standard_scale", f"""{CLEANED}
SELECT id, {', '.join(f'''round(CASE WHEN s_{f} = 0 THEN CAST(0 AS DOUBLE) ELSE ({f} - m_{f}) / s_{f} END, 6) AS {f}''' for f in FEATURES)}
FROM cleaned, (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in FEATURES)} FROM cleaned) facts""", ["fx_features"])
def standard_scale(spark, sf):
    return rounded(prep.standard_scale(fx.view(spark, sf, "fx_features").drop("peopleCount"), FEATURES), 6, *FEATURES)


@query("train_test_split", """
SELECT id, CAST(CAST('0x' || substr(md5('0:' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976
       < CAST(0.15 AS DOUBLE) AS is_test FROM fx_features""", ["fx_features"])
def train_test_split(spark, sf):
    return prep.split_flag(fx.view(spark, sf, "fx_features").select("id"), "id")


@query("train_test_split_exact", """
, hashed AS (SELECT id, CAST('0x' || substr(md5('0:' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM fx_features)
SELECT id, row_number() OVER (ORDER BY h, id) <= ceil(0.15 * (SELECT count(*) FROM hashed)) AS is_test FROM hashed""", ["fx_features"])
def train_test_split_exact(spark, sf):
    return prep.split_exact(fx.view(spark, sf, "fx_features").select("id"), "id")


def training_table(spark, sf):
    return fx.view(spark, sf, "fx_features")


def prepared(spark, sf, features=None):
    df = training_table(spark, sf)
    features = features or c.feature_names(df.drop("id"))
    stages = est.preparation(df, features)
    return est.prepare(df, stages, "id"), features


def _two_sql(x1, x2):
    """Least squares on two columns of ``cleaned`` by the normal equations: b1, b2, b0 and r2."""
    return f""", m AS (SELECT avg(y) AS my, avg({x1}) AS m1, avg({x2}) AS m2, var_pop({x1}) AS v1, var_pop({x2}) AS v2, var_pop(y) AS vy,
  covar_pop({x1}, {x2}) AS c12, covar_pop({x1}, y) AS c1y, covar_pop({x2}, y) AS c2y FROM cleaned),
w AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1, (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m),
fit AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0, my, sqrt(v1) AS s1, sqrt(v2) AS s2, (b1 * c1y + b2 * c2y) / vy AS r2 FROM w)"""


@query("linear_regression", f"""{CLEANED}{_two_sql("f_lines", "f_price")}
SELECT 'f_lines' AS feature, round(b1, 6) AS slope, round(b0, 6) AS intercept, round(r2, 6) AS r2 FROM fit
UNION ALL SELECT 'f_price', round(b2, 6), round(b0, 6), round(r2, 6) FROM fit""", ["fx_features"])
def linear_regression(spark, sf):
    df = c.clean_non_finite(training_table(spark, sf), FEATURES)
    model = est.create_model("linear_regression").fit(
        df.selectExpr("CAST(peopleCount AS DOUBLE) AS peopleCount", "array(f_lines, f_price) AS a").transform(_vectors))
    rows = [(f, float(b), float(model.intercept), float(model.summary.r2))
            for f, b in zip(("f_lines", "f_price"), model.coefficients)]
    return rounded(spark.createDataFrame(rows, "feature string, slope double, intercept double, r2 double"),
                   6, "slope", "intercept", "r2")


def _vectors(df):
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector("a"))


@query("coefficients", f"""{CLEANED}{_two_sql("f_qty", "f_noise")}
SELECT 'linear_regression' AS model, 'f_qty' AS feature, round(b1 * s1, 6) AS coefficient FROM fit
UNION ALL SELECT 'linear_regression', 'f_noise', round(b2 * s2, 6) FROM fit
UNION ALL SELECT 'linear_regression', '(intercept)', round(my, 6) FROM fit""", ["fx_features"])
def coefficients(spark, sf):
    rows, names = prepared(spark, sf, ["f_qty", "f_noise"])
    model = est.fit_model("linear_regression", rows)
    return rounded(est.coefficients(model, names, "linear_regression"), 6, "coefficient")


_FOLD = "CAST(floor(CAST(CAST('0x' || substr(md5('fold-0:' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976 * 5) AS INT)"


@query("lasso_cv_one_feature", f"""{CLEANED}
, z AS (SELECT y, (f_lines - avg(f_lines) OVER ()) / stddev_pop(f_lines) OVER () AS x, {_FOLD} AS fold FROM cleaned),
path AS (SELECT i, top * pow(CAST(1e-3 AS DOUBLE), CAST(i AS DOUBLE) / 99) AS alpha
         FROM (SELECT abs(covar_pop(x, y)) AS top FROM z), range(100) t(i)),
train AS (SELECT k, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, covar_pop(x, y) AS c FROM z, range(5) f(k) WHERE fold <> k GROUP BY k),
fits AS (SELECT k, i, alpha, mx, my, sign(c) * greatest(abs(c) - alpha, 0) / v AS b FROM train, path),
errors AS (SELECT k, i, alpha, avg(pow(y - my - b * (x - mx), 2)) AS mse FROM fits JOIN z ON fold = k GROUP BY ALL),
cv AS (SELECT i, alpha, avg(mse) AS mse FROM errors GROUP BY ALL)
SELECT round(alpha, 6) AS alpha, round(mse, 4) AS mse, row_number() OVER (ORDER BY mse, i) = 1 AS chosen FROM cv""", ["fx_features"])
def lasso_cv_one_feature(spark, sf):
    """With one feature the penalised fit is a soft threshold, which SQL can say."""
    alpha, path = choose_penalty(prepared(spark, sf, ["f_lines"])[0])
    table = spark.createDataFrame(path, "alpha double, mse double")
    return rounded(table.withColumn("chosen", F.col("alpha") == alpha), 6, "alpha").withColumn("mse", F.round("mse", 4))


@query("lasso_cv")
def lasso_cv(spark, sf):
    rows, names = prepared(spark, sf)
    alpha, path = choose_penalty(rows)
    table = spark.createDataFrame(path, "alpha double, mse double")
    return table.withColumn("chosen", F.col("alpha") == alpha)


def _registry(spark):
    """A registry of its own for every query, so that no result depends on what ran before."""
    return ModelRegistry(spark, scratch_path(spark, "registry"))


def _trained(spark, sf, registry, *names, search=False):
    df = training_table(spark, sf)
    return df, train_models(df, "id", registry, names, search=search)


def _scored(name, search=False):
    def run(spark, sf):
        df, models = _trained(spark, sf, _registry(spark), name, search=search)
        return score_models(models, df, "id")
    return run


query("random_forest")(_scored("random_forest"))
query("gradient_boosting")(_scored("gradient_boosting", search=True))
query("boosted_sampled")(_scored("xgboost", search=True))


def _least_squares_sql(names):
    """Predictions of least squares on the training rows, by taking one feature after the other out of those that follow."""
    on = "FILTER (WHERE NOT is_test) OVER ()"
    steps = [f"s0 AS (SELECT id, y, is_test, avg(y) {on} AS pred, y - avg(y) {on} AS ry, "
             + ", ".join(f"{n} - avg({n}) {on} AS {n}" for n in names) + " FROM flagged)"]
    for k, n in enumerate(names):
        share = f"{n} * (sum({{0}} * {n}) {on} / sum({n} * {n}) {on})"
        rest = [f"{m} - {share.format(m)} AS {m}" for m in names[k + 1:]]
        steps.append(f"s{k + 1} AS (SELECT id, y, is_test, pred + {share.format('ry')} AS pred, ry - {share.format('ry')} AS ry"
                     + "".join(f", {r}" for r in rest) + f" FROM s{k})")
    return ",\n".join(steps) + f"\nSELECT 'linear_regression' AS model, id, y AS y_true, round(pred, 2) AS y_pred, is_test FROM s{len(names)}"


_IS_TEST = "CAST(CAST('0x' || substr(md5('0:' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976 < CAST(0.15 AS DOUBLE)"


@query("score_table", f"""{CLEANED}, flagged AS (SELECT *, {_IS_TEST} AS is_test FROM cleaned),
{_least_squares_sql([f for f in FEATURES if f != "f_const"])}""", ["fx_features"])
def score_table(spark, sf):
    """Trained on the training rows, scored on all."""
    return rounded(_scored("linear_regression")(spark, sf), 2, "y_pred")



@query("grid_search")
def grid_search(spark, sf):
    """Every point of the boosting grids; the lasso chooses its penalty on a path of its own, see ``lasso_cv``."""
    df = training_table(spark, sf)
    train = prep.split_flag(df, "id").filter("NOT is_test").drop("is_test")
    features = c.feature_names(df.drop("id"))
    rows = est.prepare(train, est.preparation(df, features), "id")
    tables = [est.grid_search(name, rows)[1].withColumn("model", F.lit(name)) for name in ("gradient_boosting", "xgboost")]
    return tables[0].unionByName(tables[1])


@query("feature_importance")
def feature_importance(spark, sf):
    df, models = _trained(spark, sf, _registry(spark), "random_forest")
    return est.importances(models["random_forest"].stages[-1], c.feature_names(df.drop("id")), "random_forest")


def _asked_hash(name):
    asked = {"search": False, "n_alphas": config.LASSO_ALPHAS, "test_size": config.TEST_SIZE, "seed": config.SEED,
             "grid": config.MODEL_GRIDS.get(name)}
    return params_hash_of(asked)


SAVED = [("lasso", "LinearRegressionModel"), ("linear_regression", "LinearRegressionModel")]


@query("model_metadata", " UNION ALL ".join(
    f"SELECT '{n}' AS model_name, '{t}' AS model_type, '{_asked_hash(n)}' AS params_hash" for n, t in SAVED))
def model_metadata(spark, sf):
    registry = _registry(spark)
    _trained(spark, sf, registry, *[n for n, _ in SAVED])
    return registry.metadata().select("model_name", "model_type", "params_hash")


@query("latest_model", " UNION ALL ".join(f"SELECT '{n}' AS model_name, true AS loads" for n, _ in SAVED))
def latest_model(spark, sf):
    """Trained twice: the newer model of each name, and whether its path is the newest row's."""
    registry = _registry(spark)
    df, names = training_table(spark, sf), [n for n, _ in SAVED]
    for seed in (0, 1):
        train_models(df, "id", registry, names, seed=seed)
    newest = registry.metadata().groupBy("model_name").agg(F.max("saved_time").alias("saved_time"))
    paths = registry.metadata().join(newest, ["model_name", "saved_time"]).select("model_name", F.col("path").alias("newest"))
    return registry.latest().join(paths, "model_name").select("model_name", (F.col("path") == F.col("newest")).alias("loads"))


@query("model_leaderboard")
def model_leaderboard(spark, sf):
    return train_and_compare(training_table(spark, sf), "id", _registry(spark), search=True)


# --- whole jobs --------------------------------------------------------------------------------------


@query("building_features", f"""{NEAR_POIS}{NEAR_CENTRES}{WATER_COUNTS}{ROADS_BY_BUILDING}{POPULATION}
SELECT b.building_id, u.population, {POI_COLUMNS}, {WATER_COLUMNS}, {ROAD_COLUMNS}
FROM fx_buildings b JOIN population u ON b.building_id = u.building_id
LEFT JOIN poi_wide p ON b.building_id = p.building_id
LEFT JOIN water_counts w ON b.building_id = w.building_id LEFT JOIN centre_dist d ON b.building_id = d.building_id
{ROAD_JOINS}""", ["fx_buildings", "fx_pois", "fx_water", "fx_roads", "fx_pixels"])
def flagship(spark, sf):
    out = building_features(fx.buildings(spark, sf), raster(spark, sf), fx.pois(spark, sf),
                            fx.water(spark, sf), fx.roads(spark, sf))
    return rounded(out.drop("footprint"), 3, *POI_DISTS, "nearest_water_dist", "nearest_road_dist")


@query("clean_attributes", f"""{DICTIONARY}
SELECT f.id, f.peopleCount, CAST(t_int AS BIGINT) AS t_int, CAST(t_int_null AS DOUBLE) AS t_int_null,
       CAST(nullif(t_blank, '') AS DOUBLE) AS t_blank, {', '.join(f'd_{n}.code AS {n}' for n in LABELS)},
       CAST(t_allnull AS DOUBLE) AS t_allnull, n_price FROM fx_attributes f
{' '.join(f'''JOIN d d_{n} ON d_{n}."column" = '{n}' AND d_{n}.label = coalesce(f.{n}, 'MISSING')''' for n in LABELS)}""",
       ["fx_attributes"])
def clean_job(spark, sf):
    return clean_attributes(fx.view(spark, sf, "fx_attributes"))
