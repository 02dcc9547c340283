"""Spatial joins. Each takes searching points as a frame with an ``x`` and a ``y`` column.

The results are made of equi-joins on cells, exact distance tests inside the join, and partial
aggregates, so no step holds a whole layer, cell or shape in one task.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthgrid.functions import geometry as g
from hearthgrid.functions.sql import num
from hearthgrid.operators.cell_search import nearest_of_cell, polygons_of_cell, search_cells
from hearthgrid.operators.cells import CELL, explode_edges, covered_centres, spread_edges, \
    spread_points, with_cell
from hearthgrid.operators.skew import join_cells

CELL_SIZE = 1000.0


def points_within(queries, objects, radius, inclusive=False, size=CELL_SIZE, split=True, sides=None):
    """Inner join of points closer than ``radius``; adds ``dist``.

    ``queries`` has ``x, y``; ``objects`` has ``ox, oy``. With ``inclusive`` a pair at exactly the
    radius counts as well; with ``sides`` the search region is a polygon drawn in the circle.
    Crowded cells are split over several tasks unless ``split`` is off.
    """
    left = with_cell(queries, "x", "y", size)
    right = spread_points(objects, "ox", "oy", radius, size)
    joined = join_cells(left, right, ["x", "y"]) if split else left.join(right, CELL)
    joined = joined \
        .selectExpr("*", f"{g.distance('x', 'y', 'ox', 'oy')} AS dist")
    near = f"dist <= {num(radius)}" if inclusive else \
        g.in_reach("dist", "x", "y", "ox", "oy", radius, sides)
    return joined.filter(near).drop(*CELL)


def edges_within(queries, edges, radius, size=CELL_SIZE, split=True, spread=None):
    """Inner join of points with edges at most ``radius`` away; adds ``dist``.

    A point meets a shape once per near edge; group by both to get one row per pair. Crowded cells
    are split over several tasks unless ``split`` is off. ``spread`` passes the edges' cells if they are known.
    """
    left = with_cell(queries, "x", "y", size)
    right = spread_edges(edges, radius, size) if spread is None else spread
    joined = join_cells(left, right, ["x", "y"]) if split else left.join(right, CELL)
    joined = joined \
        .selectExpr("*", f"{g.segment_distance('x', 'y', *g.EDGE)} AS dist")
    return joined.filter(f"dist <= {num(radius)}").drop(*g.EDGE, *CELL)


def polygons_at(queries, query_key, layer, radius=0.0, size=CELL_SIZE, sides=None, spread=None):
    """One row per point and polygon that meet, with ``inside`` and ``dist``.

    ``query_key`` lists the columns that identify a point and includes what is to be kept of it.
    With radius 0 only the containing polygons come back, points on the boundary left out.
    Otherwise also the polygons within ``radius`` of the point, or, with ``sides``, those that touch the
    polygon drawn in that circle. ``spread`` passes the cells of the layer's edges if they are known.

    Polygons are cut into edges and covered cell centres. To tell whether a point is inside, walk
    from it to the centre of its cell, first along x and then along y: if the centre is inside, the
    point is as well, unless an odd number of edges is crossed on the way. Only edges in that one
    cell can be crossed, so no point ever sees the whole outline of a large shape.
    """
    key = layer.key
    schema = _fields(queries, query_key, layer.df, [key], "inside boolean, dist double")
    search = polygons_of_cell(query_key, key, float(radius), float(size), sides)
    # A point that comes twice meets a polygon once.
    spots = queries.select(*dict.fromkeys([*query_key, "x", "y"])).distinct()
    left, pieces = with_cell(spots, "x", "y", size), polygon_pieces(layer, radius, size, spread)
    # A point in a cell that no polygon reaches meets nothing and need not be searched.
    left = left.join(pieces.select(*CELL).distinct(), CELL, "left_semi")
    return search_cells(left, pieces, [key], search, schema)


def polygon_counts_at(queries, query_key, layer, radius=0.0, size=CELL_SIZE, sides=None, spread=None):
    """The number ``n`` of the polygons that :func:`polygons_at` finds, per point that has any; a point whose pieces
    are many may come several times."""
    schema = _fields(queries, query_key, layer.df, [], "n bigint")
    search = polygons_of_cell(query_key, layer.key, float(radius), float(size), sides, counted=True)
    left, pieces = with_cell(queries, "x", "y", size), polygon_pieces(layer, radius, size, spread)
    return search_cells(left, pieces, [layer.key], search, schema)


def polygon_pieces(layer, radius, size, spread=None):
    """Edges and covered centres by cell; ``core`` is 1 for the latter."""
    edges = explode_edges(layer)
    walls = spread_edges(edges, radius, size) if spread is None else spread
    cores = covered_centres(edges, layer.key, size).selectExpr("*", "1 AS core")
    return walls.selectExpr("*", "0 AS core").unionByName(cores, allowMissingColumns=True)


def _fields(left, left_names, right, right_names, more):
    return StructType([left.schema[n] for n in left_names] + [right.schema[n] for n in right_names]
                      + StructType.fromDDL(more).fields)


def _crossings(met, query_key, key, side, wall):
    """``inside`` and the smallest ``wall`` of every point and polygon, from a point's pieces in its cell."""
    cx, cy = f"((gx + 0.5D) * {side})", f"((gy + 0.5D) * {side})"
    along_x = f"{g.spans('y1', 'y2', 'y')} AND ({g.edge_right_of('x', 'y', *g.EDGE)} " \
              f"!= {g.edge_right_of(cx, 'y', *g.EDGE)})"
    along_y = f"{g.spans('x1', 'x2', cx)} AND ({g.edge_above(cx, 'y', *g.EDGE)} " \
              f"!= {g.edge_above(cx, cy, *g.EDGE)})"
    seen = met.selectExpr(*query_key, key,
                          f"core + if({along_x}, 1, 0) + if({along_y}, 1, 0) AS crossed",
                          f"{g.on_edge('x', 'y', *g.EDGE)} AS touches", f"{wall} AS wall")
    return seen.groupBy(*query_key, key).agg(F.expr(
        "sum(crossed) % 2 = 1 AND NOT coalesce(max(touches), false) AS inside"),
        F.min("wall").alias("wall"))


def polygons_around(queries, query_key, layer, level="_level"):
    """One row per point and polygon that contains it, for polygons of very different sizes in one equi-join.

    Every polygon has a ``level``; its cells are 4^level wide, and its pieces are keyed by level and cell, as in a linear
    quadtree. A point is looked up in its cell on every level in use.
    """
    key = layer.key
    used = sorted(r[0] for r in layer.df.select(level).distinct().collect())
    levels = F.array(*[F.lit(k).cast("int") for k in used]) if used else F.expr("CAST(array() AS ARRAY<INT>)")
    points = queries.withColumn(level, F.explode(levels)).withColumn("_side", F.expr(f"power(4D, {level})"))
    met = with_cell(points, "x", "y", "_side").join(quadtree_pieces(layer, level), [level, *CELL])
    return _crossings(met, query_key, key, "_side", "CAST(NULL AS DOUBLE)").filter("inside").select(*query_key, key)


def quadtree_pieces(layer, level="_level"):
    """Edges and covered centres of polygons, each in cells of its polygon's own level."""
    sized = layer.with_df(layer.df.withColumn("_side", F.expr(f"power(4D, {level})")))
    edges = explode_edges(sized, level, "_side")
    walls = spread_edges(edges, 0.0, "_side").selectExpr("*", "0 AS core")
    cores = covered_centres(edges, layer.key, "_side", [level, "_side"]).selectExpr("*", "1 AS core")
    return walls.unionByName(cores, allowMissingColumns=True).drop("_side")


def nearest_left(queries, query_key, edges, edge_key, radius, size=CELL_SIZE):
    """Left join of every point with its nearest shape at most ``radius`` away, all ties kept.

    Points with nothing in reach stay, with nulls.
    """
    schema = _fields(queries, query_key, edges, [edge_key], "dist double")
    found = search_cells(with_cell(queries, "x", "y", size), spread_edges(edges, radius, size), [edge_key],
                         nearest_of_cell(query_key, edge_key, float(radius)), schema)
    # A rank filter is cut down to the leading rows before the shuffle, so a point with very
    # many shapes around it does not become one large group.
    order = Window.partitionBy(*query_key).orderBy("dist")
    ties = found.select(*query_key, edge_key, "dist") \
        .withColumn("place", F.rank().over(order)).filter("place = 1") \
        .groupBy(*query_key, edge_key).agg(F.min("dist").alias("dist"))
    return queries.join(ties, query_key, "left")
