"""Planar geometry as SQL expressions over nested arrays of ``STRUCT<x, y>``."""

import math

from pyspark.sql import types as T

from hearthgrid.functions.sql import let, num

DEPTH = {"point": 0, "line": 1, "polygon": 2}
EDGE = ("x1", "y1", "x2", "y2")


def point(x, y):
    return f"struct({x} AS x, {y} AS y)"


def box_rings(xmin, ymin, xmax, ymax):
    """Rectangle as a polygon with one closed ring, counter-clockwise."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return f"array(array({', '.join(point(x, y) for x, y in corners)}))"


def depth(df, name):
    """Number of array levels around the points of a geometry column."""
    kind, levels = df.schema[name].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, levels = kind.elementType, levels + 1
    return levels


def as_multi(df, name, kind):
    """A single-part line or polygon in its one-element multi-part form."""
    if kind == "mixed":
        return name
    levels, wanted = depth(df, name), DEPTH[kind] + (kind != "point")
    if levels == wanted:
        return name
    if levels == wanted - 1:
        return f"array({name})"
    raise ValueError(f"column {name!r} has {levels} array levels, a {kind} needs {wanted}")


def edges(path):
    """Consecutive point pairs of a ring or line as ``STRUCT<x1, y1, x2, y2>``."""
    return (f"transform(slice({path}, 2, greatest(size({path}) - 1, 0)), (q, j) -> struct("
            f"{path}[j].x AS x1, {path}[j].y AS y1, q.x AS x2, q.y AS y2))")


def path_edges(path):
    """Edges of a line; a line of one point gives one edge of no length."""
    return (f"if(size({path}) = 1, transform({path}, q -> struct(q.x AS x1, q.y AS y1, q.x AS x2, "
            f"q.y AS y2)), {edges(path)})")


def all_edges(multi, kind):
    """Every edge of a multi-line or multi-polygon in one flat array."""
    if kind == "mixed":
        spots = f"transform({multi}.points, q -> struct(q.x AS x1, q.y AS y1, q.x AS x2, q.y AS y2))"
        return f"concat({spots}, {all_edges(f'{multi}.lines', 'line')}, {all_edges(f'{multi}.polygons', 'polygon')})"
    if kind == "line":
        return f"flatten(transform({multi}, ln -> {path_edges('ln')}))"
    return f"flatten(transform(flatten({multi}), rg -> {edges('rg')}))"


def mixed(kind, points="NULL", lines="NULL", polygons="NULL"):
    """A geometry of any kind: its GeoJSON type and its points, lines and polygons, empty arrays where it has none."""
    spot = "STRUCT<x: DOUBLE, y: DOUBLE>"
    parts = []
    for name, value, levels in (("points", points, 1), ("lines", lines, 2), ("polygons", polygons, 3)):
        kind_of = "ARRAY<" * levels + spot + ">" * levels
        parts.append(f"coalesce(CAST({value} AS {kind_of}), CAST(array() AS {kind_of})) AS {name}")
    return f"struct({kind} AS kind, {', '.join(parts)})"


def as_mixed(multi, kind):
    """A point, multi-line or multi-polygon as a geometry of any kind."""
    made = {"point": ("'Point'", f"array({multi})"), "line": ("'MultiLineString'", "NULL", multi),
            "polygon": ("'MultiPolygon'", "NULL", "NULL", multi)}
    return multi if kind == "mixed" else f"if({multi} IS NULL, NULL, {mixed(*made[kind])})"


def mixed_vertices(geom):
    """All corners of a geometry of any kind in one flat array."""
    return f"concat({geom}.points, flatten({geom}.lines), flatten(flatten({geom}.polygons)))"


# --- centroids ------------------------------------------------------------------


def _ring_moments(ring, sign):
    """Area and first moments of a ring, relative to ``og``; ``sign`` is -1 for holes.

    Whatever direction the ring was drawn in, its own area counts as positive.
    """
    steps = (f"transform({edges(ring)}, e -> struct("
             "(e.x1 - og.x) * (e.y2 - og.y) - (e.x2 - og.x) * (e.y1 - og.y) AS c, "
             "e.x1 + e.x2 - 2 * og.x AS sx, e.y1 + e.y2 - 2 * og.y AS sy))")
    return (f"aggregate({steps}, struct(0D AS a, 0D AS mx, 0D AS my), "
            "(m, s) -> struct(m.a + s.c AS a, m.mx + s.sx * s.c AS mx, m.my + s.sy * s.c AS my), "
            f"m -> struct({sign} * abs(m.a) AS a, {sign} * sign(m.a) * m.mx AS mx, "
            f"{sign} * sign(m.a) * m.my AS my))")


def _polygon_centroid(multi):
    rings = (f"flatten(transform({multi}, pg -> transform(pg, (rg, k) -> "
             f"{_ring_moments('rg', 'if(k = 0, 1, -1)')})))")
    middle = (f"aggregate({rings}, struct(0D AS a, 0D AS mx, 0D AS my), (t, r) -> "
              "struct(t.a + r.a AS a, t.mx + r.mx AS mx, t.my + r.my AS my), "
              f"t -> if(t.a != 0, {point('og.x + t.mx / (3 * t.a)', 'og.y + t.my / (3 * t.a)')}, NULL))")
    by_area = let("og", f"get(get(get({multi}, 0), 0), 0)", middle)
    # A polygon without area falls back to the middle of its outline.
    return f"coalesce({by_area}, {_line_centroid(f'flatten({multi})')})"


def _line_centroid(multi):
    steps = ("transform(" + all_edges(multi, "line") + ", e -> struct("
             "sqrt((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)) AS w, "
             "(e.x1 + e.x2) / 2 - og.x AS mx, (e.y1 + e.y2) / 2 - og.y AS my))")
    zero = "struct(0D AS w, 0D AS mx, 0D AS my, 0D AS n, 0D AS sx, 0D AS sy)"
    add = ("struct(t.w + s.w AS w, t.mx + s.w * s.mx AS mx, t.my + s.w * s.my AS my, "
           "t.n + 1 AS n, t.sx + s.mx AS sx, t.sy + s.my AS sy)")
    by_length = point("og.x + t.mx / t.w", "og.y + t.my / t.w")
    by_count = point("og.x + t.sx / t.n", "og.y + t.sy / t.n")
    found = (f"aggregate({steps}, {zero}, (t, s) -> {add}, "
             f"t -> CASE WHEN t.w > 0 THEN {by_length} WHEN t.n > 0 THEN {by_count} END)")
    return let("og", f"get(get({multi}, 0), 0)", found)


def centroid(geom, kind):
    """Area-weighted for polygons, length-weighted for lines, the point itself for points."""
    if kind == "point":
        return geom
    if kind == "mixed":
        # Of what a geometry holds, the parts with the most dimensions decide.
        spots = (f"aggregate({geom}.points, struct(0D AS n, 0D AS x, 0D AS y), (m, q) -> struct(m.n + 1 AS n, m.x + q.x AS x, "
                 f"m.y + q.y AS y), m -> if(m.n > 0, {point('m.x / m.n', 'm.y / m.n')}, NULL))")
        return (f"CASE WHEN size({geom}.polygons) > 0 THEN {_polygon_centroid(f'{geom}.polygons')} "
                f"WHEN size({geom}.lines) > 0 THEN {_line_centroid(f'{geom}.lines')} ELSE {spots} END")
    return _polygon_centroid(geom) if kind == "polygon" else _line_centroid(geom)


# --- a point that is certainly inside ----------------------------------------------


def _scan_height(rings):
    """Midway between the vertex heights just below and just above the middle of the outline."""
    ys = f"transform(flatten({rings}), q -> q.y)"
    rim = f"transform({rings}[0], q -> q.y)"
    facts = f"struct({ys} AS ys, array_min({rim}) AS lo, array_max({rim}) AS hi)"
    return let("v", facts,
               "(coalesce(array_max(filter(v.ys, h -> h <= (v.lo + v.hi) / 2)), v.lo) + "
               "coalesce(array_min(filter(v.ys, h -> h > (v.lo + v.hi) / 2)), v.hi)) / 2")


def _widest_section(rings, height):
    """``STRUCT<w, x, y>`` of the widest stretch of the scan line that runs inside."""
    walls = (f"filter(flatten(transform({rings}, rg -> {edges('rg')})), "
             f"e -> (e.y1 > {height}) != (e.y2 > {height}))")
    hits = f"array_sort(transform({walls}, e -> e.x1 + ({height} - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1)))"
    sections = ("array_max(transform(filter(transform(xs, (a, k) -> struct(k AS k, a AS a, "
                "get(xs, k + 1) AS b)), s -> s.k % 2 = 0 AND s.b IS NOT NULL), s -> struct("
                f"s.b - s.a AS w, (s.a + s.b) / 2 AS x, {height} AS y)))")
    return let("xs", hits, sections)


def inner_point(multi):
    """A point inside the polygon, by a horizontal scan line through its middle."""
    best = (f"array_max(filter(transform({multi}, pg -> "
            f"{let('ht', _scan_height('pg'), _widest_section('pg', 'ht'))}), s -> s IS NOT NULL))")
    found = let("bs", best, f"if(bs IS NULL, NULL, {point('bs.x', 'bs.y')})")
    return f"coalesce({found}, {_polygon_centroid(multi)})"


# --- distances and containment --------------------------------------------------------


def distance(ax, ay, bx, by):
    return (f"sqrt((({ax}) - ({bx})) * (({ax}) - ({bx})) + (({ay}) - ({by})) * (({ay}) - ({by})))")


def in_reach(dist, px, py, ox, oy, radius, sides=None):
    """Strictly within a circle, or within the regular polygon of ``sides`` corners drawn in it.

    The first corner lies due east of the centre. A polygon of 64 corners is what tools that draw
    buffers as polygons test by default.
    """
    if sides is None:
        return f"{dist} < {num(radius)}"
    slice_, half = 2 * math.pi / sides, math.pi / sides
    bearing = f"pmod(atan2({oy} - {py}, {ox} - {px}), {num(slice_)}) - {num(half)}"
    return f"{dist} * cos({bearing}) < {num(sure_reach(radius, sides))}"


def sure_reach(radius, sides=None):
    """The distance up to which every direction is in reach."""
    return radius if sides is None else radius * math.cos(math.pi / sides)


def segment_distance(px, py, x1, y1, x2, y2):
    """Distance from a point to a segment; a segment of no length counts as a point."""
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    along = (f"(({px} - {x1}) * {dx} + ({py} - {y1}) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0D)")
    t = f"least(1D, greatest(0D, coalesce({along}, 0D)))"
    ox, oy = f"({px} - ({x1} + {t} * {dx}))", f"({py} - ({y1} + {t} * {dy}))"
    return f"sqrt({ox} * {ox} + {oy} * {oy})"


def segment_in_reach(dist, px, py, x1, y1, x2, y2, radius, sides=None):
    """Whether a segment at distance ``dist`` touches the search region: the circle, or the polygon drawn in it.

    Between the polygon's inner and outer circle the segment is cut at each of the polygon's sides; it touches if
    something is left.
    """
    if sides is None:
        return f"{dist} <= {num(radius)}"
    sure = num(sure_reach(radius, sides))
    facing = f"(2 * k + 1) * {num(math.pi / sides)}"
    ahead = [f"(cos({facing}) * ({x} - {px}) + sin({facing}) * ({y} - {py}))" for x, y in ((x1, y1), (x2, y2))]
    side = f"struct({ahead[0]} AS a, {ahead[1]} AS b)"
    cut = f"({sure} - s.a) / nullif(s.b - s.a, 0D)"
    low = f"CASE WHEN s.b < s.a THEN {cut} WHEN s.b = s.a AND s.a > {sure} THEN 2D ELSE 0D END"
    high = f"if(s.b > s.a, {cut}, 1D)"
    left = (f"aggregate(transform(sequence(0, {sides - 1}), k -> {side}), struct(0D AS t0, 1D AS t1), (m, s) -> "
            f"struct(greatest(m.t0, {low}) AS t0, least(m.t1, {high}) AS t1), m -> m.t0 <= m.t1)")
    return f"({dist} <= {sure} OR ({dist} <= {num(radius)} AND {left}))"


def turn(px, py, x1, y1, x2, y2):
    """Positive if the point lies to the left of the directed edge, zero if in line with it."""
    return f"(({x2} - {x1}) * ({py} - {y1}) - ({y2} - {y1}) * ({px} - {x1}))"


def on_edge(px, py, x1, y1, x2, y2):
    """Exactly on the segment. Axis-parallel edges are exact in floating point."""
    return (f"({turn(px, py, x1, y1, x2, y2)} = 0 "
            f"AND {px} BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2}) "
            f"AND {py} BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}))")


def edge_right_of(px, py, x1, y1, x2, y2):
    """For an edge spanning the height ``py``: does it cross that height right of ``px``?"""
    side = turn(px, py, x1, y1, x2, y2)
    return (f"(CASE WHEN {x1} > {px} AND {x2} > {px} THEN true "
            f"WHEN {x1} <= {px} AND {x2} <= {px} THEN false "
            f"WHEN {y2} > {y1} THEN {side} > 0 ELSE {side} < 0 END)")


def edge_above(px, py, x1, y1, x2, y2):
    """For an edge spanning ``px``: does it pass above ``py``? Judged by the same turn as
    :func:`edge_right_of`, so that the two never disagree about a point next to an edge.
    An exact hit counts as "not right of", which is "above" for rising edges only."""
    side = turn(px, py, x1, y1, x2, y2)
    return (f"(CASE WHEN {y1} > {py} AND {y2} > {py} THEN true "
            f"WHEN {y1} <= {py} AND {y2} <= {py} THEN false "
            f"WHEN {x2} > {x1} THEN {side} < 0 OR ({side} = 0 AND {y2} > {y1}) "
            f"ELSE {side} > 0 OR ({side} = 0 AND {y2} < {y1}) END)")


def spans(a, b, at):
    """Half-open test: exactly one of ``a`` and ``b`` lies beyond ``at``."""
    return f"(({a} > {at}) != ({b} > {at}))"


def point_in_polygon(px, py, multi):
    """Strictly inside, holes respected, the boundary excluded."""
    args = (px, py, "e.x1", "e.y1", "e.x2", "e.y2")
    hit = f"{spans('e.y1', 'e.y2', py)} AND {edge_right_of(*args)}"
    return (f"aggregate({all_edges(multi, 'polygon')}, struct(0 AS hits, false AS rim), "
            f"(m, e) -> struct(m.hits + if({hit}, 1, 0) AS hits, m.rim OR {on_edge(*args)} AS rim), "
            "m -> m.hits % 2 = 1 AND NOT m.rim)")


def point_path_distance(px, py, multi, kind):
    """Distance from a point to the nearest edge of a line or polygon outline."""
    near = segment_distance(px, py, "e.x1", "e.y1", "e.x2", "e.y2")
    return f"array_min(transform({all_edges(multi, kind)}, e -> {near}))"


def point_geometry_distance(px, py, geom, kind):
    """Distance from a point to a point, line or polygon; zero inside a polygon."""
    if kind == "point":
        return distance(px, py, f"{geom}.x", f"{geom}.y")
    outline = point_path_distance(px, py, geom, kind)
    if kind == "line":
        return outline
    if kind == "mixed":
        inside = f"size({geom}.polygons) > 0 AND {point_in_polygon(px, py, f'{geom}.polygons')}"
        return f"if({inside}, 0D, {outline})"
    return f"if({point_in_polygon(px, py, geom)}, 0D, {outline})"


def pixel_index(lon, lat, x0, y0, dx, dy):
    """Row and column of the raster cell that holds a coordinate; row 0 is the northernmost."""
    return (f"CAST(floor(({y0} - ({lat})) / {dy}) AS BIGINT)",
            f"CAST(floor((({lon}) - {x0}) / {dx}) AS BIGINT)")
