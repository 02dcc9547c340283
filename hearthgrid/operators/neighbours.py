"""Counts and nearest distances around buildings.

Buildings at exactly the same place share their answer, and so do copies of a point of interest.
Both sides are therefore reduced to distinct places before any spatial join, which is what keeps
a pile of records at one default location from meeting another pile record by record.
"""

from pyspark.sql import functions as F

from hearthgrid.config import ROAD_RADIUS, ROAD_WIDTH, WATER_CENTRE_MARGIN, WATER_RADIUS, \
    WEB_MERCATOR
from hearthgrid.layer import require_columns
from hearthgrid.operators.cell_search import POINT_ROWS, ROAD_ROWS, points_of_cell, roads_of_cell, search_cells
from hearthgrid.operators.cells import CELL, explode_edges, spread_edges, spread_points, with_cell
from hearthgrid.operators.crowded import crowded_edge_rows, crowded_polygon_counts, crowded_rows
from hearthgrid.operators.poi_shapes import crowded_shape_rows, shape_pairs, shape_table, split_points
from hearthgrid.operators.skew import PAIR_BUDGET, attach, hot_cells, written
from hearthgrid.operators.spatial_join import CELL_SIZE, polygon_counts_at
from hearthgrid.session import materialize

INFINITY = float("inf")
XY = ["x", "y"]
PLACE = ["place", "x", "y"]
MOST_TYPES = 5000


def places(df, x="x", y="y"):
    """Distinct places ``place, x, y`` with the number ``n`` of rows at each, written out once.

    Every search below starts from this narrow table instead of the footprints, and is grouped and
    joined by the whole number ``place``. (Doubles as keys are normalised by a join but not by a
    group, so each join after a group would shuffle again.)
    """
    found = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()) \
        .groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(found.withColumn("place", F.monotonically_increasing_id()), "places")


def with_places(buildings, inner=False):
    """Key and place of every building, and all distinct places."""
    located = materialize(buildings.located(inner=inner, srid=WEB_MERCATOR), "located")
    return located, places(located)


def near_rows(spots, objects, radius, size=CELL_SIZE, budget=PAIR_BUDGET, sides=None):
    """Rows ``place, kind, n, dist`` to be summed (``n``) and minimised (``dist``) per place and kind.

    ``objects`` has ``ox, oy, kind, copies``. Where a cell would ask for more than ``budget`` pair
    tests it is searched by :func:`crowded_rows`, all other cells pair by pair.
    """
    celled = with_cell(spots.select(*PLACE), "x", "y", size)
    cold, crowd = by_crowding(celled, crowded_cells(celled, objects, radius, size, budget))
    reached = spread_points(objects.filter("kind IS NOT NULL"), "ox", "oy", radius, size)
    rows = search_cells(with_cell(cold, "x", "y", size), reached, ["ox", "oy"],
                        points_of_cell(float(radius), sides), POINT_ROWS)
    if crowd is None:
        return rows
    return rows.unionByName(crowded_rows(crowd, objects, radius, size, sides=sides))


def by_crowding(celled, hot):
    """The places outside and inside the hot cells; the latter None if there are no such cells."""
    if hot is None:
        return celled.drop(*CELL), None
    hot = hot.select(*CELL)
    return (celled.join(hot, CELL, "left_anti").drop(*CELL),
            celled.join(hot, CELL, "left_semi").drop(*CELL))


def crowded_cells(celled, objects, radius, size, budget):
    """Cells with more than ``budget`` pair tests, written out; None if there are none."""
    steps = int(radius // size) + 1
    around = f"explode(sequence({-steps}, {steps}))"
    held = with_cell(objects, "ox", "oy", size).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    reach = held.selectExpr("n", "gx", "gy", f"{around} AS sx") \
        .selectExpr("n", "gx + sx AS gx", "gy", f"{around} AS sy") \
        .selectExpr("n", "gx", "gy + sy AS gy").groupBy(*CELL).agg(F.sum("n").alias("n"))
    asked = celled.groupBy(*CELL).agg(F.count(F.lit(1)).alias("q"))
    tests = F.col("q").cast("double") * F.col("n")
    return written(asked.join(reach, CELL).filter(tests > F.lit(float(budget))).select(*CELL))


def at_places(features, spots):
    """Features by ``place`` with the coordinates of the place instead."""
    return spots.select(*PLACE).join(features, "place").drop("place")


def onto(buildings, features):
    """The feature columns joined to the full building rows."""
    return buildings.df.join(features.drop(*XY), buildings.key, "left")


def poi_types(df, column="poi_type"):
    """All POI types, sorted. Each one becomes two columns, so more than ``MOST_TYPES`` of them are an error."""
    found = [r[0] for r in df.select(column).distinct().limit(MOST_TYPES + 2).collect() if r[0] is not None]
    if len(found) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} POI types: each would become two columns")
    return sorted(found)


def poi_places(pois):
    """Distinct (place, type) of a POI layer, with the number of copies, written out once."""
    located = pois.projected().located("poi_type", names=("ox", "oy"))
    return materialize(located.withColumnRenamed("poi_type", "kind").groupBy("ox", "oy", "kind")
                       .agg(F.count(F.lit(1)).alias("copies")), "pois")


def shape_rows(spots, pois, radius, size=CELL_SIZE, budget=PAIR_BUDGET, sides=None):
    """The same rows for POI of a mixed layer that are more than a point: in range if all of the shape is.

    The distance is to the nearest part of the shape, 0 inside a polygon.
    """
    shapes = shape_table(pois, radius)
    celled = with_cell(spots.select(*PLACE), "x", "y", size)
    cold, crowd = by_crowding(celled, crowded_cells(celled, shapes.select("ox", "oy"), radius, size, budget))
    rows = shape_pairs(cold, shapes, radius, size, sides)
    return rows if crowd is None else rows.unionByName(crowded_shape_rows(crowd, shapes, radius, size, sides))


def poi_names(types):
    """A name to use in columns for every type. Types that differ by case only are numbered in sort order,
    since column names do not tell them apart: ``Shop`` and ``shop`` become ``Shop`` and ``shop_2``."""
    names, taken = {}, set()
    for t in types:
        name, n = t, 1
        while name.lower() in taken:
            n += 1
            name = f"{t}_{n}"
        taken.add(name.lower())
        names[t] = name
    return names


def fill_counts(df, names):
    """0 for the counts of places that had nothing in range."""
    counts = [f"count_{n}" for n in names]
    return df.withColumns({c: F.coalesce(F.col(_quoted(c)), F.lit(0)) for c in counts}) if counts else df


def _quoted(column):
    return "`" + column.replace("`", "``") + "`"


def poi_by_place(spots, pois, radius, types=None, size=CELL_SIZE, sides=None, budget=PAIR_BUDGET):
    """The POI types' names, and ``count_<name>`` and ``nearest_<name>_dist`` per place with any in range."""
    points, shapes = split_points(pois)
    rows = []
    if points is not None:
        objects = poi_places(points)
        rows.append(near_rows(spots, objects, radius, size, budget, sides))
    if shapes is not None:
        rows.append(shape_rows(spots, shapes, radius, size, budget, sides))
    if types is None:
        types = poi_types(objects, "kind") if shapes is None else poi_types(pois.df)
    rows = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    out, names = [], poi_names(types)
    for t, name in names.items():
        is_t = F.col("kind") == F.lit(t)
        out.append(F.sum(F.when(is_t, F.col("n")).otherwise(F.lit(0))).alias(f"count_{name}"))
        out.append(F.min(F.when(is_t, F.col("dist"))).alias(f"nearest_{name}_dist"))
    return list(names.values()), rows.groupBy("place").agg(*out) if out else rows.select("place").distinct()


def poi_features(buildings, pois, radius=1000.0, types=None, size=CELL_SIZE, sides=None, budget=PAIR_BUDGET):
    """Buildings with a count and a nearest distance for each POI type.

    The count is 0 and the distance null where nothing is in range. ``sides`` searches a regular
    polygon in place of the circle. POI may be of any kind; a shape is in range if all of it is.
    """
    located, spots = with_places(buildings)
    names, found = poi_by_place(spots, pois, radius, types, size, sides, budget)
    out = attach(located, at_places(found, spots), XY, spots, buildings.key)
    return onto(buildings, fill_counts(out, names))


def water_by_place(spots, water, radius, size=CELL_SIZE, budget=PAIR_BUDGET, sides=None):
    """``count_water`` and ``nearest_water_dist`` per place; either may be missing."""
    layer = water.projected()
    return water_counts(spots, layer, radius, size, budget, sides) \
        .join(water_centre_distance(spots, layer, radius, size, budget), "place", "full")


def water_counts(spots, layer, radius, size=CELL_SIZE, budget=PAIR_BUDGET, sides=None):
    """Shapes around or within the radius of each place that has any; a radius below 10 micrometres is an error.

    With ``sides``, shapes around or touching the polygon drawn in the circle.
    """
    if radius < 1e-5:
        raise ValueError("the radius is too small")
    edges = explode_edges(layer)
    celled = with_cell(spots.select(*PLACE), "x", "y", size)
    spread = materialize(spread_edges(edges, radius, size), "spread")
    cold, crowd = by_crowding(celled, hot_cells(celled, spread, budget))
    counts = polygon_counts_at(cold, ["place"], layer, radius, size, sides=sides, spread=spread) \
        .groupBy("place").agg(F.sum("n").alias("count_water"))
    if crowd is None:
        return counts
    more = crowded_polygon_counts(crowd, edges, layer.key, radius, size, sides=sides) \
        .groupBy("place").agg(F.sum("n").alias("count_water")).filter("count_water > 0")
    return counts.unionByName(more)


def water_centre_distance(spots, layer, radius, size=CELL_SIZE, budget=PAIR_BUDGET):
    """Distance to the nearest water centre, strictly within the radius and its margin."""
    centres = layer.located(names=("ox", "oy")).select("ox", "oy").distinct() \
        .withColumns({"kind": F.lit("water"), "copies": F.lit(1).cast("bigint")})
    rows = near_rows(spots, materialize(centres, "centres"), radius + WATER_CENTRE_MARGIN, size, budget)
    return rows.groupBy("place").agg(F.min("dist").alias("nearest_water_dist"))


def water_features(buildings, water, radius=WATER_RADIUS, size=CELL_SIZE, budget=PAIR_BUDGET, sides=None):
    """Buildings with the number of water shapes within the radius of a point inside the building,
    and the distance to the nearest water centre (infinity if none).

    ``sides`` counts shapes that touch a regular polygon in place of the circle.
    """
    located, spots = with_places(buildings, inner=True)
    found = at_places(water_by_place(spots, water, radius, size, budget, sides), spots)
    out = attach(located, found, XY, spots, buildings.key)
    return onto(buildings, fill_water(out))


def fill_water(df):
    return df.fillna({"count_water": 0}).withColumn(
        "nearest_water_dist", F.coalesce(F.col("nearest_water_dist"), F.lit(INFINITY)))


def usable_roads(roads):
    """Roads with a positive width; null and NaN widths drop out."""
    require_columns(roads.df, [ROAD_WIDTH])
    width = F.col(ROAD_WIDTH)
    return roads.with_df(roads.df.filter((width > 0) & ~F.isnan(width.cast("double"))))


def road_by_place(spots, roads, radius, size=CELL_SIZE, budget=PAIR_BUDGET):
    """Per place: roads in range, roads tied for nearest, and the nearest distance.

    Where a cell would ask for more than ``budget`` distances it is searched by
    :func:`crowded_edge_rows`, all other cells edge by edge.
    """
    layer = usable_roads(roads).projected()
    edges, queries = explode_edges(layer), spots.select(*PLACE)
    celled = with_cell(queries, "x", "y", size)
    spread = materialize(spread_edges(edges, radius, size), "spread")
    cold, crowd = by_crowding(celled, hot_cells(celled, spread, budget))
    if crowd is None:
        return _per_place(_road_rows(cold, spread, layer.key, radius, size))
    exact, settled = crowded_edge_rows(crowd, edges, layer.key, radius, size)
    none = {"dist": F.lit(None).cast("double"), "ties": F.lit(None).cast("bigint")}
    found = exact.unionByName(settled.withColumns(none))
    return _per_place(_road_rows(cold, spread, layer.key, radius, size).unionByName(found))


def _road_rows(queries, spread, key, radius, size):
    """Rows ``place, n, ties, dist``, from a place's cell or from parts of it."""
    return search_cells(with_cell(queries, "x", "y", size), spread, [key], roads_of_cell(key, float(radius)), ROAD_ROWS)


def _per_place(rows):
    """Counts and the nearest distance per place."""
    ties = rows.groupBy("place", "dist").agg(F.sum("n").alias("n"), F.sum("ties").alias("ties"))
    return ties.groupBy("place").agg(
        F.sum("n").alias("count_roads"), F.min_by("ties", "dist").alias("count_roads_tied"),
        F.min("dist").alias("nearest_road_dist"))


def fill_roads(df):
    """No road in range: none counted, one row of the nearest join, infinitely far."""
    return df.fillna({"count_roads": 0, "count_roads_tied": 1}).withColumn(
        "nearest_road_dist", F.coalesce(F.col("nearest_road_dist"), F.lit(INFINITY)))


def road_features(buildings, roads, radius=ROAD_RADIUS, size=CELL_SIZE, budget=PAIR_BUDGET):
    """Buildings with ``count_roads`` (roads in range), ``count_roads_tied`` (rows a nearest join
    gives, hence 1 when there is none) and ``nearest_road_dist``."""
    located, spots = with_places(buildings)
    found = at_places(road_by_place(spots, roads, radius, size, budget), spots)
    out = attach(located, found, XY, spots, buildings.key)
    return onto(buildings, fill_roads(out))
