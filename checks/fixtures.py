"""Input layers derived from the star-schema tables, as SQL that Spark and DuckDB both run."""

from hearthgrid import Layer
from hearthgrid.functions import geometry as g

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

_MERCATOR = """CAST(6378137 AS DOUBLE) * radians(lon) AS x,
    CAST(6378137 AS DOUBLE) * ln(tan(pi() / CAST(4 AS DOUBLE) + radians(lat) / CAST(2 AS DOUBLE))) AS y"""


def _scatter(key, kx, ky):
    """Spread keys over longitude 119.6 to 119.8 and latitude 30.2 to 30.4."""
    return f"""CAST(119.6 AS DOUBLE) + CAST(({key} * {kx}) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS lon,
    CAST(30.2 AS DOUBLE) + CAST(({key} * {ky}) % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS lat"""


VIEWS = {
    "fx_buildings": f"""
SELECT building_id, lon, lat, x, y,
       x - CAST(5 + building_id % 15 AS DOUBLE) AS xmin, x + CAST(5 + building_id % 15 AS DOUBLE) AS xmax,
       y - CAST(4 + building_id % 10 AS DOUBLE) AS ymin, y + CAST(4 + building_id % 10 AS DOUBLE) AS ymax
FROM (SELECT building_id, lon, lat, {_MERCATOR}
      FROM (SELECT c_custkey AS building_id, {_scatter('c_custkey', 7919, 104729)} FROM customer) a) b""",
    "fx_pois": f"""
SELECT poi_id, poi_type, lon, lat, {_MERCATOR}
FROM (SELECT o_orderkey AS poi_id, replace(lower(substr(o_orderpriority, 3)), ' ', '_') AS poi_type,
             {_scatter('(o_orderkey + 17)', 7919, 104729)} FROM orders) a""",
    "fx_roads": f"""
SELECT road_id, CASE WHEN road_id % 13 = 0 THEN NULL ELSE CAST(w AS DOUBLE) END AS fwidth, x AS x1, y AS y1,
       x + CAST((road_id * 31) % 1501 - 750 AS DOUBLE) AS x2, y + CAST((road_id * 37) % 1501 - 750 AS DOUBLE) AS y2
FROM (SELECT road_id, w, {_MERCATOR}
      FROM (SELECT p_partkey AS road_id, p_size % 5 AS w, {_scatter('p_partkey', 15331, 26681)} FROM part) a) b""",
    "fx_water": f"""
SELECT water_id, x - CAST(50 + (water_id * 53) % 400 AS DOUBLE) AS xmin, x + CAST(50 + (water_id * 53) % 400 AS DOUBLE) AS xmax,
       y - CAST(40 + (water_id * 29) % 300 AS DOUBLE) AS ymin, y + CAST(40 + (water_id * 29) % 300 AS DOUBLE) AS ymax
FROM (SELECT water_id, {_MERCATOR}
      FROM (SELECT s_suppkey AS water_id, {_scatter('s_suppkey', 3571, 6143)} FROM supplier) a) b""",
    "fx_areas": """
SELECT CAST(n_nationkey AS BIGINT) AS objectid, n_name AS fname, lower(n_name) AS eng_name,
       CAST(119.6 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.04 AS DOUBLE) AS lon_min,
       CAST(119.636 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.04 AS DOUBLE) AS lon_max,
       CAST(30.2 AS DOUBLE) + floor(CAST(n_nationkey AS DOUBLE) / CAST(5 AS DOUBLE)) * CAST(0.04 AS DOUBLE) AS lat_min,
       CAST(30.236 AS DOUBLE) + floor(CAST(n_nationkey AS DOUBLE) / CAST(5 AS DOUBLE)) * CAST(0.04 AS DOUBLE) AS lat_max
FROM nation
UNION ALL
SELECT CAST(100 + r_regionkey AS BIGINT), r_name, lower(r_name), CAST(119.6 AS DOUBLE), CAST(119.7 AS DOUBLE),
       CAST(30.2 AS DOUBLE) + CAST(r_regionkey AS DOUBLE) * CAST(0.04 AS DOUBLE), CAST(30.22 AS DOUBLE) + CAST(r_regionkey AS DOUBLE) * CAST(0.04 AS DOUBLE)
FROM region""",
    "fx_pixels": """
SELECT CAST(floor(CAST(o_orderkey AS DOUBLE) / CAST(400 AS DOUBLE)) AS BIGINT) AS row_idx, CAST(o_orderkey % 400 AS BIGINT) AS col_idx,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(-99999 AS DOUBLE) ELSE CAST((o_orderkey * 31) % 1000 AS DOUBLE) / CAST(8 AS DOUBLE) END AS value
FROM orders a""",
    "fx_attributes": """
SELECT p_partkey AS id, (p_partkey * 7919) % 1938 AS peopleCount, CAST(p_partkey AS STRING) AS GlobalID, p_size AS count_w_all,
       CAST(p_size AS STRING) AS t_int,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS t_int_null,
       CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN concat(chr(9), CAST(p_size AS STRING), chr(10))
            ELSE CAST(p_size AS STRING) END AS t_blank,
       CASE WHEN p_partkey % 50 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS t_mixed,
       CASE WHEN p_partkey % 50 = 0 THEN '1d' ELSE CAST(p_size AS STRING) END AS t_suffix,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'MISSING' ELSE p_brand END AS t_label,
       CAST(NULL AS STRING) AS t_allnull, p_retailprice AS n_price
FROM part""",
    "fx_features": """
SELECT o.o_orderkey AS id,
       CAST(floor(o.o_totalprice / CAST(2000 AS DOUBLE)) + CAST(3 * coalesce(l.n_lines, 0) AS DOUBLE) AS BIGINT) AS peopleCount,
       CASE WHEN o.o_orderkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN o.o_orderkey % 89 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o.o_totalprice END AS f_price,
       CAST(l.n_lines AS DOUBLE) AS f_lines, l.sum_qty AS f_qty, l.max_price AS f_max_price,
       CAST(o.o_custkey % 17 AS DOUBLE) AS f_noise, CAST(1 AS DOUBLE) AS f_const
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, max(l_extendedprice) AS max_price
                         FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    "fx_predictions": """
SELECT 'm1' AS model, id, CAST(peopleCount AS DOUBLE) AS y_true, CAST(peopleCount AS DOUBLE) + CAST(id % 21 - 10 AS DOUBLE) AS y_pred FROM fx_features
UNION ALL
SELECT 'm2' AS model, id, CAST(peopleCount AS DOUBLE) AS y_true, CAST(peopleCount AS DOUBLE) * CAST(0.5 AS DOUBLE) AS y_pred FROM fx_features""",
}

NEEDS = {"fx_predictions": ["fx_features"]}

# Affine of fx_pixels.
RASTER = {"x0": 119.6, "y0": 30.4, "dx": 0.2 / 400, "dy": 0.2 / 150, "nodata": -99999.0}


def with_clause(*names):
    """``WITH`` text that defines the named views, for a statement over the base tables."""
    wanted = []
    for name in names:
        wanted += [n for n in NEEDS.get(name, []) + [name] if n not in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + "\n"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark, sf_dir, name):
    """A derived view as a DataFrame."""
    text = with_clause(name) + f"SELECT * FROM {name}"
    used = {t: table(spark, sf_dir, t) for t in TABLES if _mentions(text, t)}
    for t in used:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        text = text.replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(text, **used)


def _mentions(text, name):
    return any(f"FROM {name}{end}" in text for end in (" ", ")", "\n"))


# --- layers -------------------------------------------------------------------------


def _layer(spark, sf_dir, name, columns, key, geom, kind, srid):
    return Layer(view(spark, sf_dir, name).selectExpr(*columns), key, geom, kind, srid)


METRE_BOX = g.box_rings("xmin", "ymin", "xmax", "ymax")
DEGREE_BOX = g.box_rings("lon_min", "lat_min", "lon_max", "lat_max")


def buildings(spark, sf_dir):
    """Footprints as polygons in 3857."""
    return _layer(spark, sf_dir, "fx_buildings", ["building_id", f"{METRE_BOX} AS footprint"],
                  "building_id", "footprint", "polygon", 3857)


def building_points(spark, sf_dir):
    """The same buildings as points in degrees."""
    return _layer(spark, sf_dir, "fx_buildings", ["building_id", "struct(lon AS x, lat AS y) AS spot"],
                  "building_id", "spot", "point", 4326)


def pois(spark, sf_dir):
    return _layer(spark, sf_dir, "fx_pois",
                  ["poi_id", "poi_type", "struct(lon AS x, lat AS y) AS spot"],
                  "poi_id", "spot", "point", 4326)


def roads(spark, sf_dir):
    line = "array(struct(x1 AS x, y1 AS y), struct(x2 AS x, y2 AS y)) AS path"
    return _layer(spark, sf_dir, "fx_roads", ["road_id", "fwidth AS FWIDTH", line],
                  "road_id", "path", "line", 3857)


def water(spark, sf_dir):
    return _layer(spark, sf_dir, "fx_water", ["water_id", f"{METRE_BOX} AS shape"],
                  "water_id", "shape", "polygon", 3857)


def mixed_pois(spark, sf_dir):
    """The water boxes as POI of all kinds side by side: polygons, their lower left and upper right corners, the diagonals."""
    low, high = g.point("xmin", "ymin"), g.point("xmax", "ymax")
    shape = (f"CASE water_id % 3 WHEN 0 THEN {g.mixed(chr(39) + 'Polygon' + chr(39), polygons=f'array({METRE_BOX})')} "
             f"WHEN 1 THEN {g.mixed(chr(39) + 'MultiPoint' + chr(39), points=f'array({low}, {high})')} "
             f"ELSE {g.mixed(chr(39) + 'LineString' + chr(39), lines=f'array(array({low}, {high}))')} END AS shape")
    kind = "if(water_id % 2 = 0, 'lake', 'pond') AS poi_type"
    return _layer(spark, sf_dir, "fx_water", ["water_id AS poi_id", kind, shape], "poi_id", "shape", "mixed", 3857)


def areas(spark, sf_dir):
    return _layer(spark, sf_dir, "fx_areas",
                  ["objectid AS OBJECTID", "fname AS FNAME", "eng_name AS Eng_Name",
                   f"{DEGREE_BOX} AS shape"], "OBJECTID", "shape", "polygon", 4326)
