"""Counts and nearest distances where very many points meet very many points.

In a crowded cell the number of pairs is out of reach, but hardly any pair matters by itself. Both
sides are therefore compared cell by cell, on finer and finer grids:

* two cells wholly within the radius of each other settle the count of all their points at once;
* two cells wholly out of reach are dropped;
* for the nearest distance only cells that may hold something closer than the best cell are kept.

None of the joins is broadcast: tables of a few megabytes on disk, of which a search has many, would fill the driver.
What is left undecided is compared point by point as soon as it is few enough, and the search ends with
the level on which nothing else is left. The answer is exact.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as g
from hearthgrid.functions.sql import num
from hearthgrid.operators.cell_search import POINT_ROWS, ROAD_ROWS, points_of_cell, roads_of_cell, search_cells
from hearthgrid.operators.cells import CELL, covered_centres, finite, spread_edges
from hearthgrid.session import materialize

# Each level is four times finer than the one before. On the last one a cell of a kilometre has become a
# micrometre: the places and POI in it are one each, and any radius has a level below it.
LEVELS = 15
# Pairs that two cells may have to be compared pair by pair, in blocks of places.
BLOCKED = 1 << 24
# Rounding slack in metres, far above that of the coordinates: bounds may only err on the safe side.
SLACK = 1e-6


def _fine(df, x, y, size):
    side = num(size / 4**LEVELS)
    return df.filter(finite(x, y)).selectExpr(
        "*", f"CAST(floor({x} / {side}) AS BIGINT) AS fx", f"CAST(floor({y} / {side}) AS BIGINT) AS fy")


def _at(level, x, y):
    shift = 2 * (LEVELS - level)
    return [f"shiftright(fx, {shift}) AS {x}", f"shiftright(fy, {shift}) AS {y}"]


def _query_cells(q, level):
    up = _at(level - 1, "ux", "uy") if level else []
    return q.selectExpr(*_at(level, "qx", "qy"), *up) \
        .groupBy("qx", "qy", *(["ux", "uy"] if level else [])).agg(F.count(F.lit(1)).alias("nq"))


def _object_cells(p, level):
    up = _at(level - 1, "vx", "vy") if level else []
    return p.selectExpr("kind", "copies", *_at(level, "px", "py"), *up) \
        .groupBy("px", "py", "kind", *(["vx", "vy"] if level else [])) \
        .agg(F.count(F.lit(1)).alias("np"), F.sum("copies").alias("n"))


def _judge(pairs, level, radius, size, small, sides):
    """Bounds of each cell pair, and what is to become of it."""
    side, r, sure = num(size / 4**level), float(radius), g.sure_reach(radius, sides)
    near = [f"greatest(abs(q{a} - p{a}) - 1, 0) * {side}" for a in "xy"]
    far = [f"(abs(q{a} - p{a}) + 1) * {side}" for a in "xy"]
    bounded = pairs.selectExpr(
        "*", f"sqrt(pow({near[0]}, 2) + pow({near[1]}, 2)) AS lo",
        f"sqrt(pow({far[0]}, 2) + pow({far[1]}, 2)) AS hi").filter(f"lo < {num(r + SLACK)}")
    same = Window.partitionBy("qx", "qy", "kind")
    reached = F.expr(f"if(hi < {num(sure - SLACK)}, hi, NULL)")
    judged = bounded.withColumn("best", F.least("best", F.min(reached).over(same))) \
        .selectExpr("*", f"open AND hi < {num(sure - SLACK)} AS settled",
                    f"lo <= best + {num(SLACK)} AS close")
    judged = judged.withColumn("open", F.expr("open AND NOT settled")) \
        .filter("settled OR open OR close")
    few = "true" if level == LEVELS else f"nq * np <= {small}"
    return judged.selectExpr("*", f"(open OR close) AND ({few}) AS leaf",
                             f"(open OR close) AND NOT ({few}) AS finer")


def _children(pairs, q, p, level):
    up = pairs.filter("finer").selectExpr("qx AS ux", "qy AS uy", "px AS vx", "py AS vy", "kind",
                                          "best", "open")
    return up.join(_query_cells(q, level).hint("merge"), ["ux", "uy"]) \
        .join(_object_cells(p, level).hint("merge"), ["vx", "vy", "kind"]).drop("ux", "uy", "vx", "vy")


def crowded_rows(queries, objects, radius, size, small=BLOCKED, sides=None):
    """Rows ``place, kind, n, dist`` to be summed (``n``) and minimised (``dist``) per place and kind.

    ``queries`` has ``place, x, y``; ``objects`` has ``ox, oy, kind, copies``.
    """
    q, p = _fine(queries, "x", "y", size), _fine(objects, "ox", "oy", size)
    steps = int(radius // size) + 1
    around = f"explode(sequence({-steps}, {steps}))"
    spread = _object_cells(p, 0).selectExpr("*", f"{around} AS sx") \
        .selectExpr("*", f"{around} AS sy").selectExpr("*", "px + sx AS qx", "py + sy AS qy")
    pairs = spread.join(_query_cells(q, 0).hint("merge"), ["qx", "qy"]).drop("sx", "sy") \
        .withColumns({"best": F.lit(float("inf")), "open": F.lit(True)})
    out = None
    for level in range(LEVELS + 1):
        judged = materialize(_judge(pairs, level, radius, size, small, sides), "crowded")
        for rows in (_settled_rows(judged, q, level), _leaf_rows(judged, q, p, level, radius, size, sides)):
            out = rows if out is None else out.unionByName(rows)
        if level == LEVELS or judged.filter("finer").isEmpty():
            return out
        pairs = _children(judged, q, p, level + 1)


def _settled_rows(judged, q, level):
    counts = judged.filter("settled").groupBy("qx", "qy", "kind").agg(F.sum("n").alias("n"))
    return q.selectExpr("place", *_at(level, "qx", "qy")).join(counts.hint("merge"), ["qx", "qy"]) \
        .selectExpr("place", "kind", "n", "CAST(NULL AS DOUBLE) AS dist")


def _leaf_rows(judged, q, p, level, radius, size, sides):
    """The pairs of cells that are few enough, searched in blocks of places; objects that are settled already count 0."""
    side, reach = num(size / 4**level), num(radius + size * 1e-6)
    gap = [f"greatest(q{a} * {side} - o{a}, o{a} - (q{a} + 1) * {side}, 0D)" for a in "xy"]
    leaves = judged.filter("leaf").select("qx", "qy", "px", "py", "kind", "open")
    pieces = leaves.join(p.selectExpr("ox", "oy", "kind", "copies", *_at(level, "px", "py")).hint("merge"), ["px", "py", "kind"]) \
        .filter(f"pow({gap[0]}, 2) + pow({gap[1]}, 2) <= pow({reach}, 2)") \
        .selectExpr("qx AS gx", "qy AS gy", "ox", "oy", "kind", "if(open, copies, 0L) AS copies")
    cells = leaves.selectExpr("qx AS gx", "qy AS gy").distinct()
    points = q.selectExpr("place", "x", "y", *_at(level, "gx", "gy")).join(cells.hint("merge"), CELL, "left_semi")
    return search_cells(points, pieces, ["ox", "oy"], points_of_cell(float(radius), sides), POINT_ROWS)


# --- lines ------------------------------------------------------------------------
#
# The same idea with shapes in place of points: from the distance between the centre of a cell and
# a shape follow bounds for every place in that cell, half a diagonal to either side.


def _edge_bounds(rows, key, level, radius, size, sides):
    """Rows ``qx, qy, key, edge`` with what is to become of the shape in that cell."""
    side, r, sure = size / 4**level, float(radius), g.sure_reach(radius, sides)
    half = side * 2**0.5 / 2 + SLACK
    centre = [f"((q{a} + 0.5D) * {num(side)})" for a in "xy"]
    rows = rows.selectExpr("*", f"{g.segment_distance(*centre, *g.EDGE)} AS d")
    shape = rows.groupBy("qx", "qy", key).agg(F.min("d").alias("m"))
    best = shape.groupBy("qx", "qy").agg((F.min("m") + F.lit(half)).alias("best"))
    judged = shape.join(best.hint("merge"), ["qx", "qy"]).selectExpr(
        "qx", "qy", key, "m", f"m + {num(half)} < {num(sure)} AS within",
        f"m - {num(half)} <= least(best, {num(r)}) AS close", f"m - {num(half)} <= {num(r)} AS near")
    # An edge that is farther by a whole diagonal can nowhere be the nearest one of its shape. A polygon may be
    # touched by any edge in range, the nearest or not.
    wanted = f"d <= m + {num(2 * half)}" if sides is None else f"d - {num(half)} <= {num(r)}"
    return rows.join(judged.hint("merge"), ["qx", "qy", key]).filter(f"near AND {wanted}")


def crowded_edge_rows(queries, edges, key, radius, size, small=BLOCKED, first=0, held=None, nearest=True, sides=None):
    """Places against edges: exact rows ``place, n, ties, dist``, and ``place, n`` to be added.

    The first frame has, for every place, the shapes in range that had to be looked up, and of those that may be its nearest
    the distance of the nearest and how many are tied for it. The second has the number of shapes in range that were
    settled for whole cells. Both are found cell by cell, in blocks of places: pairs are never rows.

    The search starts on level ``first``. ``held`` lists cells of that level and shapes,
    ``qx, qy, key``, that are counted elsewhere and get 0 for ``n``. Without ``nearest`` the
    distances serve the counts only. ``sides`` counts shapes that touch the polygon drawn in the circle.
    """
    q = _fine(queries, "x", "y", size)
    rows = spread_edges(edges, radius, size / 4**first).withColumnsRenamed({"gx": "qx", "gy": "qy"}) \
        .select("qx", "qy", key, *g.EDGE).join(_query_cells(q, first).drop("ux", "uy").hint("merge"), ["qx", "qy"])
    if held is not None:
        rows = rows.join(held.select("qx", "qy", key, F.lit(0).alias("n")).hint("merge"), ["qx", "qy", key], "left")
    weight = "coalesce(n, 1)" if held is not None else "1"
    rows = rows.selectExpr("qx", "qy", key, *g.EDGE, "nq", f"{weight} AS n", "true AS open")
    exact, settled = None, None
    for level in range(first, LEVELS + 1):
        judged = _edge_bounds(rows, key, level, radius, size, sides)
        judged = judged.selectExpr("*", "open AND within AS settled", "open AND NOT within AS unsure")
        load = judged.groupBy("qx", "qy").agg(F.count(F.lit(1)).alias("edges"))
        few = "true" if level == LEVELS else f"nq * edges <= {small}"
        kept = "unsure OR close" if nearest else "unsure"
        judged = judged.join(load.hint("merge"), ["qx", "qy"]).selectExpr(
            "qx", "qy", key, *g.EDGE, "n", "settled", "unsure", f"({kept}) AS kept", f"({few}) AS leaf")
        judged = materialize(judged, "crowded")
        here = q.selectExpr("place", "x", "y", *_at(level, "qx", "qy"))
        leaves = judged.filter("kept AND leaf")
        cells = leaves.selectExpr("qx AS gx", "qy AS gy").distinct()
        met = search_cells(
            here.withColumnsRenamed({"qx": "gx", "qy": "gy"}).join(cells.hint("merge"), CELL, "left_semi"),
            leaves.selectExpr("qx AS gx", "qy AS gy", key, *g.EDGE, "CAST(if(unsure, n, 0) AS BIGINT) AS n"), [key],
            roads_of_cell(key, float(radius), "n", nearest, sides), ROAD_ROWS)
        whole = judged.filter("settled").select("qx", "qy", key, "n").distinct() \
            .groupBy("qx", "qy").agg(F.sum("n").alias("n")).join(here.hint("merge"), ["qx", "qy"]).select("place", "n")
        exact = met if exact is None else exact.unionByName(met)
        settled = whole if settled is None else settled.unionByName(whole)
        finer = judged.filter("kept AND NOT leaf")
        if level == LEVELS or finer.isEmpty():
            return exact, settled
        rows = finer.selectExpr("qx AS ux", "qy AS uy", key, *g.EDGE, "n", "unsure AS open") \
            .join(_query_cells(q, level + 1).hint("merge"), ["ux", "uy"]).drop("ux", "uy")


def crowded_polygon_counts(queries, edges, key, radius, size, small=BLOCKED, sides=None):
    """``place, n``, to be summed: the polygons around or at most ``radius`` from each place.

    On a level whose cells are smaller than the radius, a place farther than that from an outline
    shares its side of it with its whole cell. So the polygons that cover the centre of its cell
    are counted once per cell, and from the outlines within range only those of other polygons.
    ``sides`` counts polygons that touch the polygon drawn in the circle.
    """
    first = next(k for k in range(LEVELS + 1) if size / 4**k * 2**0.5 < g.sure_reach(radius, sides))
    q = _fine(queries, "x", "y", size)
    cells = _query_cells(q, first).select("qx", "qy")
    covers = covered_centres(edges, key, size / 4**first) \
        .withColumnsRenamed({"gx": "qx", "gy": "qy"}).join(cells.hint("merge"), ["qx", "qy"])
    covers = materialize(covers, "covers")
    exact, settled = crowded_edge_rows(queries, edges, key, radius, size, small, first, covers, False, sides)
    around = covers.groupBy("qx", "qy").agg(F.count(F.lit(1)).alias("n")) \
        .join(q.selectExpr("place", *_at(first, "qx", "qy")).hint("merge"), ["qx", "qy"]).select("place", "n")
    return exact.select("place", "n").unionByName(settled).unionByName(around)
