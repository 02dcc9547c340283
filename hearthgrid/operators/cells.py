"""Grid cells as join keys.

Every spatial search here has a bounded reach, so each becomes an equi-join on ``(gx, gy)`` and an
exact test. A searching point lies in one cell; what it looks for is spread over every cell within
reach. One cell per searching point means that no pair comes twice.
"""

from pyspark.sql import functions as F

from hearthgrid.functions import geometry as g
from hearthgrid.functions.sql import num

CELL = ["gx", "gy"]


def _side(size):
    """A cell size as SQL text; it is given as a number, or as the name of a column that holds each row's own."""
    return size if isinstance(size, str) else num(size)


def _cell(value, size):
    return f"CAST(floor(({value}) / {_side(size)}) AS BIGINT)"


def finite(*cols):
    """Rows whose coordinates can be placed; null or empty geometry can match nothing."""
    return " AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('Infinity')" for c in cols)


def with_cell(df, x, y, size):
    """The one cell each point lies in."""
    return df.filter(finite(x, y)).selectExpr(
        "*", f"{_cell(x, size)} AS gx", f"{_cell(y, size)} AS gy")


def _reach(radius, size):
    # A sliver more than the radius, so that rounding never loses a pair at the very edge.
    if isinstance(size, str):
        return f"({num(radius)} + {size} * 1e-6D)"
    return num(float(radius) + size * 1e-6)


def spread_points(df, x, y, radius, size):
    """One row per cell within ``radius`` of each point."""
    reach, side = _reach(radius, size), _side(size)

    def cells(v):
        return f"explode(sequence({_cell(f'{v} - {reach}', size)}, {_cell(f'{v} + {reach}', size)}))"

    def gap(cell, v):
        return f"greatest({cell} * {side} - {v}, {v} - ({cell} + 1) * {side}, 0D)"

    out = df.filter(finite(x, y)).selectExpr("*", f"{cells(x)} AS gx") \
        .selectExpr("*", f"{cells(y)} AS gy")
    # Corner cells can be out of reach although their column and their row are not.
    return out.filter(f"pow({gap('gx', x)}, 2) + pow({gap('gy', y)}, 2) <= pow({reach}, 2)")


def explode_edges(layer, *keep):
    """One row per edge of a line or polygon layer: the key, ``keep``, and x1, y1, x2, y2."""
    edges = g.all_edges(layer.multi(), layer.kind)
    return layer.df.select(layer.key, *keep, F.expr(f"inline({edges})"))


def spread_edges(df, radius, size):
    """One row per cell within ``radius`` of each edge.

    Cells are listed column by column along the edge, so a long slanted edge gives as many rows as
    its length asks for, not as many as its bounding box.
    """
    reach, side = _reach(radius, size), _side(size)

    def height_at(x, upright):
        t = f"least(1D, greatest(0D, ({x} - x1) / (x2 - x1)))"
        return f"if(x1 = x2, {upright}, y1 + {t} * (y2 - y1))"

    out = df.filter(finite(*g.EDGE)).selectExpr("*", (
        f"explode(sequence({_cell(f'least(x1, x2) - {reach}', size)}, "
        f"{_cell(f'greatest(x1, x2) + {reach}', size)})) AS gx"))
    out = out.selectExpr("*", f"{height_at(f'(gx * {side} - {reach})', 'y1')} AS ya",
                         f"{height_at(f'((gx + 1) * {side} + {reach})', 'y2')} AS yb")
    return out.selectExpr("*", (
        f"explode(sequence({_cell(f'least(ya, yb) - {reach}', size)}, "
        f"{_cell(f'greatest(ya, yb) + {reach}', size)})) AS gy")).drop("ya", "yb")


def covered_centres(edges, key, size, keep=()):
    """Cells whose centre lies inside the polygon, as ``key, gx, gy`` and ``keep``, columns that are one per key.

    Each edge that crosses the height of a row of centres is reduced to the last centre left of it.
    Sorted, these come in pairs, and the centres between the two of a pair are inside.
    """
    half, side = (f"({size} / 2D)" if isinstance(size, str) else num(size / 2.0)), _side(size)
    rows = edges.filter(finite(*g.EDGE)).selectExpr("*", (
        f"explode(sequence(CAST(ceil((least(y1, y2) - {half}) / {side}) AS BIGINT) - 1, "
        f"CAST(floor((greatest(y1, y2) - {half}) / {side}) AS BIGINT) + 1)) AS gy"))
    rows = rows.selectExpr("*", f"(gy + 0.5D) * {side} AS cy").filter(g.spans("y1", "y2", "cy"))
    rows = rows.selectExpr("*", (
        f"CAST(floor((x1 + (cy - y1) / (y2 - y1) * (x2 - x1) - {half}) / {side}) AS BIGINT) AS near"))

    def left_of(cell):
        return g.edge_right_of(f"(({cell} + 0.5D) * {side})", "cy", *g.EDGE)

    last = (f"CASE WHEN {left_of('(near + 1)')} THEN near + 1 "
            f"WHEN {left_of('near')} THEN near ELSE near - 1 END")
    hits = rows.selectExpr(key, *keep, "gy", f"{last} AS m").groupBy(key, *keep, "gy") \
        .agg(F.expr("array_sort(collect_list(m)) AS ms"))
    # Neighbours in sorted order: element 0 with 1, 2 with 3 and so on.
    runs = ("filter(transform(ms, (m, i) -> struct(i AS i, m + 1 AS a, get(ms, i + 1) AS b)), "
            "r -> r.i % 2 = 0 AND r.a <= r.b)")
    inside = hits.selectExpr(key, *keep, "gy", f"inline({runs}) AS (i, a, b)")
    return inside.selectExpr(key, *keep, "explode(sequence(a, b)) AS gx", "gy")
