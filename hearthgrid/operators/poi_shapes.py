"""POI that are lines, polygons, several points or any mixture: counts and nearest distances around places.

A shape is in range if all of it is, which for a convex search region means all of its corners. Every shape is one row, keyed
by the cell of its first corner: a place that has the shape in range has that corner in range. Shapes wider than the region
are dropped before anything is joined. The places of a cell are searched in blocks (``cell_search.shapes_of_cell``): a shape that is
in range of a whole block is counted once for it, and only what is neither that nor out of range, or may be the nearest, is looked at place by
place. A shape counts there as its corners.

Where very many places meet very many shapes, whole cells of places are judged at once: from a shape's farthest corner and
nearest part as seen from the centre of a cell follow bounds for every place in it, half a diagonal to either side.
"""

from pyspark.sql import functions as F

from hearthgrid.functions import geometry as g
from hearthgrid.functions.sql import let, num
from hearthgrid.operators.cell_search import POINT_ROWS, search_cells, shapes_of_cell
from hearthgrid.operators.cells import CELL, finite, spread_points, with_cell
from hearthgrid.operators.crowded import BLOCKED, LEVELS, SLACK, _at, _fine, _query_cells
from hearthgrid.session import materialize

# Pairs of a cell that are left to the search in blocks; a cell with more is cut into finer ones first.
SMALL = BLOCKED


def split_points(layer):
    """The rows of a layer that are one point each, as a point layer, and all others as a mixed one."""
    if layer.kind == "point":
        return layer, None
    if layer.kind != "mixed":
        return None, layer.any_kind()
    alone = F.expr(f"size({layer.geom}.points) = 1 AND size({layer.geom}.lines) = 0 AND size({layer.geom}.polygons) = 0")
    points = layer.df.filter(alone).withColumn(layer.geom, F.expr(f"{layer.geom}.points[0]"))
    return type(layer)(points, layer.key, layer.geom, "point", layer.srid), layer.with_df(layer.df.filter(~alone))


def shape_table(pois, radius):
    """``shape_id, kind, ox, oy, ext, shape`` of the shapes of a mixed layer that fit into the search region, written out.

    ``ext`` is the distance of the farthest corner from the first, (ox, oy).
    """
    layer = pois.projected()
    span = " AND ".join(f"array_max(transform(vs, v -> v.{a})) - array_min(transform(vs, v -> v.{a})) < {num(2.0 * radius)}"
                        for a in "xy")
    far = f"array_max(transform(vs, v -> {g.distance('vs[0].x', 'vs[0].y', 'v.x', 'v.y')}))"
    fact = let("vs", g.mixed_vertices(layer.geom), f"if(size(vs) > 0 AND {span}, struct(vs[0].x AS ox, vs[0].y AS oy, {far} AS ext), NULL)")
    found = layer.df.select(F.col("poi_type").alias("kind"), F.col(layer.geom).alias("shape"), F.expr(fact).alias("fact")) \
        .filter("fact IS NOT NULL").select("kind", "fact.*", "shape").filter(finite("ox", "oy", "ext"))
    return materialize(found.withColumn("shape_id", F.monotonically_increasing_id()), "poi_shapes")


def _near(x, y):
    return g.point_geometry_distance(x, y, "shape", "mixed")


def _outlined(shapes):
    """What the search of a cell takes: a shape's corners and edges, and how many edges, the last ones, are those of polygons."""
    none = "CAST(NULL AS DOUBLE)"
    edges = let("es", g.all_edges("shape", "mixed"),
                f"if(size(es) > 0, es, array(struct({', '.join(f'{none} AS {e}' for e in g.EDGE)})))")
    walls = f"CAST(size({g.all_edges('shape.polygons', 'polygon')}) AS BIGINT)"
    return shapes.selectExpr("shape_id", "kind", "ox", "oy", "ext", "1L AS copies",
                             f"{g.mixed_vertices('shape')} AS corners", f"{edges} AS edges", f"{walls} AS walls")


def shape_pairs(queries, shapes, radius, size, sides=None):
    """Rows ``place, kind, n, dist``, to be summed (``n``) and minimised (``dist``): the shapes in range of each place."""
    reached = spread_points(_outlined(shapes), "ox", "oy", radius, size)
    return search_cells(with_cell(queries, "x", "y", size), reached, ["shape_id"], shapes_of_cell(float(radius), sides), POINT_ROWS,
                        weight="size(corners)")


def _judged(rows, shapes, level, radius, size, sides):
    """Bounds of each cell and shape, and what is to become of it."""
    side, r, sure = size / 4**level, float(radius), g.sure_reach(radius, sides)
    half = side * 2**0.5 / 2 + SLACK
    cx, cy = (f"((q{a} + 0.5D) * {num(side)})" for a in "xy")
    far = f"array_max(transform({g.mixed_vertices('shape')}, v -> {g.distance(cx, cy, 'v.x', 'v.y')}))"
    seen = rows.join(shapes.select("shape_id", "kind", "shape"), "shape_id") \
        .selectExpr("qx", "qy", "nq", "shape_id", "kind", "open", f"{far} AS far", f"{_near(cx, cy)} AS near") \
        .filter(f"far - {num(half)} < {num(r)}").withColumn("sure", F.expr(f"far + {num(half)} < {num(sure)}"))
    best = seen.filter("sure").groupBy("qx", "qy", "kind").agg((F.min("near") + F.lit(half)).alias("best"))
    load = seen.groupBy("qx", "qy").agg(F.count(F.lit(1)).alias("shapes"))
    judged = seen.join(best, ["qx", "qy", "kind"], "left").join(load, ["qx", "qy"])
    close = f"near - {num(half)} <= coalesce(best, double('Infinity'))"
    few = "true" if level == LEVELS else f"nq * shapes <= {SMALL}"
    return judged.selectExpr("qx", "qy", "nq", "shape_id", "kind", "open AND sure AS settled", "open AND NOT sure AS unsure",
                             f"(open AND NOT sure) OR {close} AS kept", f"{few} AS leaf")


def crowded_shape_rows(queries, shapes, radius, size, sides=None):
    """The same rows, to be summed (``n``) and minimised (``dist``), without pairing everything."""
    q = _fine(queries, "x", "y", size)
    rows = spread_points(shapes.select("shape_id", "ox", "oy"), "ox", "oy", radius, size) \
        .selectExpr("shape_id", "gx AS qx", "gy AS qy").join(_query_cells(q, 0), ["qx", "qy"]) \
        .withColumn("open", F.lit(True))
    out = None
    for level in range(LEVELS + 1):
        judged = materialize(_judged(rows, shapes, level, radius, size, sides), "crowded")
        here = q.selectExpr("place", "x", "y", *_at(level, "qx", "qy"))
        whole = judged.filter("settled").groupBy("qx", "qy", "kind").agg(F.count(F.lit(1)).alias("n")) \
            .join(here, ["qx", "qy"]).selectExpr("place", "kind", "n", "CAST(NULL AS DOUBLE) AS dist")
        met = _leaf_rows(judged, here, shapes, radius, sides)
        out = whole.unionByName(met) if out is None else out.unionByName(whole).unionByName(met)
        finer = judged.filter("kept AND NOT leaf")
        if level == LEVELS or finer.isEmpty():
            return out
        rows = finer.selectExpr("qx AS ux", "qy AS uy", "shape_id", "unsure AS open") \
            .join(_query_cells(q, level + 1), ["ux", "uy"]).drop("ux", "uy")


def _leaf_rows(judged, here, shapes, radius, sides):
    """The cells whose pairs are few enough, searched in blocks; shapes that are settled already count 0."""
    cells = {"qx": "gx", "qy": "gy"}
    leaves = judged.filter("kept AND leaf").select("qx", "qy", "shape_id", "unsure").withColumnsRenamed(cells)
    points = here.withColumnsRenamed(cells).join(leaves.select(*CELL).distinct().hint("merge"), CELL, "left_semi")
    pieces = _outlined(shapes).join(leaves.hint("merge"), "shape_id").withColumn("copies", F.expr("if(unsure, 1L, 0L)"))
    return search_cells(points, pieces, ["shape_id"], shapes_of_cell(float(radius), sides), POINT_ROWS, weight="size(corners)")
