"""The searches of one cell: its places against the points or edges that reach it, as array operations.

Spark deals cells and what belongs to them out to tasks; here is only what happens within one group. The places of
a cell are taken in small blocks. What is in reach of a whole block is counted once for all its places, what is out of
reach is left out, and for the nearest distance only what may be the nearest of some place of the block is looked at. The
rest is tested pair by pair, by the same arithmetic as in SQL.
"""

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as g
from hearthgrid.operators.cells import CELL
from hearthgrid.operators.skew import PAIR_BUDGET

# Rows and pair tests that a task is meant to get: few bytes can make very many pairs, so bytes alone do not tell.
TASK_ROWS = 1_000_000
TASK_TESTS = 50_000_000
TASK_CELLS = 200
MOST_TASKS = 2_000
# Places a block is meant to have, and blocks along the side of a cell at most.
BLOCK_PLACES = 32
MOST_BLOCKS = 16
# Pairs tested at once, and pieces of a cell that one group may hold.
PAIRS_AT_ONCE = 1 << 20
MOST_PIECES = 500_000
SLACK = 1e-6

EDGE = list(g.EDGE)
# The searches travel with the job, so that the executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def search_cells(points, pieces, spread_by, search, schema, budget=PAIR_BUDGET, weight="1"):
    """``search(points, pieces)`` of every cell that has both, as rows of ``schema``.

    A piece counts as ``weight`` of them, an SQL expression. The points of a cell with more than ``budget`` tests are dealt out over several groups by a hash of their coordinates,
    and its pieces, where they are too many for one group, by a hash of the columns ``spread_by``, so that a point's rows may
    come from several groups.
    """
    left = points.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_a"))
    right = pieces.groupBy(*CELL).agg(F.sum(F.expr(weight)).alias("_b"))
    loads = left.join(right, CELL).withColumn("tests", F.col("_a").cast("double") * F.col("_b"))
    total = loads.agg(F.sum("tests").alias("tests"), F.sum(F.col("_a") + F.col("_b")).alias("rows"),
                      F.max("tests").alias("most"), F.max("_b").alias("widest"), F.count(F.lit(1)).alias("cells")).first()
    # In a single partition the rows of a point would be taken as shuffled, and not cut down before what follows.
    tasks = max(2, math.ceil((total["rows"] or 0) / TASK_ROWS),
                min(MOST_TASKS, math.ceil(max((total["tests"] or 0) / TASK_TESTS, total["cells"] / TASK_CELLS))))
    keys = CELL
    if (total["most"] or 0) > budget or (total["widest"] or 0) > MOST_PIECES:
        keys = CELL + ["_part", "_slice"]
        wide = loads.selectExpr(*CELL, f"CAST(ceil(tests / {float(budget)}D) AS INT) AS _parts",
                                f"CAST(ceil(_b / {float(MOST_PIECES)}D) AS INT) AS _slices").filter("_parts > 1 OR _slices > 1")

        def dealt(df, own, by, other, others):
            df = df.join(wide, CELL, "left")
            mine = F.pmod(F.xxhash64(*by), F.coalesce(own, F.lit(1))).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
            return df.withColumn(others[0], mine).withColumn(others[1], every).drop("_parts", "_slices")

        parts, slices = F.col("_parts"), F.col("_slices")
        points = dealt(points, parts, ["x", "y"], slices, ["_part", "_slice"])
        pieces = dealt(pieces, slices, spread_by, parts, ["_slice", "_part"])
    points, pieces = points.repartition(tasks, *keys), pieces.repartition(tasks, *keys)
    empty = points.sparkSession.createDataFrame([], schema).toArrow()

    def run(a, b):
        found = search(a, b) if a.num_rows and b.num_rows else None
        return empty if found is None else found

    return points.groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(run, schema)


def _floats(table, *names):
    return [table.column(n).to_numpy() for n in names]


def _codes(column):
    """Whole numbers for the values of a column, nulls included, and the values by number."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _blocks(x, y):
    """Row numbers of the places of each block."""
    n = min(MOST_BLOCKS, max(1, math.ceil(math.sqrt(len(x) / BLOCK_PLACES))))

    def along(v):
        low, width = v.min(), v.max() - v.min()
        return np.minimum((v - low) * (n / width), n - 1).astype(np.int64) if width > 0 else np.zeros(len(v), np.int64)

    block = along(x) * n + along(y)
    order = np.argsort(block, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(block[order])) + 1)


def _chunks(rows, width):
    step = max(1, PAIRS_AT_ONCE // max(1, width))
    return [rows[i:i + step] for i in range(0, len(rows), step)]


def _starts(sorted_codes):
    """Where each run of equal codes begins."""
    return np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])


def _in_reach(dist, px, py, ox, oy, radius, sure, sides):
    if sides is None:
        return dist < radius
    found = dist < sure
    i, j = np.nonzero((dist <= radius + SLACK) & ~found)
    slice_, half = 2 * math.pi / sides, math.pi / sides
    bearing = np.mod(np.arctan2(oy[j] - py[i], ox[j] - px[i]), slice_) - half
    found[i, j] = dist[i, j] * np.cos(bearing) < sure
    return found


def points_of_cell(radius, sides=None):
    """Rows ``place, kind, n, dist``: per place and kind the copies in range and the distance of the nearest."""
    sure_radius = g.sure_reach(radius, sides)

    def search(places, objects):
        kind, kinds = _codes(objects.column("kind"))
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        ox, oy, copies = (v[order] for v in _floats(objects, "ox", "oy", "copies"))
        place, x, y = _floats(places, "place", "x", "y")
        out = []
        for rows in _blocks(x, y):
            x0, x1, y0, y1 = x[rows].min(), x[rows].max(), y[rows].min(), y[rows].max()
            lo = np.hypot(np.maximum(0, np.maximum(x0 - ox, ox - x1)), np.maximum(0, np.maximum(y0 - oy, oy - y1)))
            near = np.flatnonzero(lo < radius + SLACK)
            if not len(near):
                continue
            k, cx, cy, weight, lo = kind[near], ox[near], oy[near], copies[near], lo[near]
            hi = np.hypot(np.maximum(cx - x0, x1 - cx), np.maximum(cy - y0, y1 - cy))
            sure = hi < sure_radius - SLACK
            settled = np.zeros(len(kinds), np.int64)
            np.add.at(settled, k[sure], weight[sure])
            best = np.full(len(kinds), np.inf)
            np.minimum.at(best, k[sure], hi[sure])
            tested = ~sure | (lo <= best[k] + SLACK)
            k, cx, cy, weight = k[tested], cx[tested], cy[tested], np.where(sure, 0, weight)[tested]
            first = _starts(k)
            for some in _chunks(rows, len(k)):
                px, py = x[some, None], y[some, None]
                dx, dy = px - cx, py - cy
                dist = np.sqrt(dx * dx + dy * dy)
                met = _in_reach(dist, x[some], y[some], cx, cy, radius, sure_radius, sides)
                n = np.add.reduceat(np.where(met, weight, 0), first, axis=1) + settled[k[first]]
                nearest = np.minimum.reduceat(np.where(met, dist, np.inf), first, axis=1)
                i, j = np.nonzero((n > 0) | (nearest < np.inf))
                out.append((place[some][i], k[first][j], n[i, j], nearest[i, j]))
        if not out:
            return None
        place, code, n, dist = (np.concatenate(v) for v in zip(*out))
        return pa.table({"place": place, "kind": kinds.take(pa.array(code)), "n": n.astype(np.int64), "dist": dist})

    return search


POINT_ROWS = "place bigint, kind string, n bigint, dist double"


def _lists(column, *names):
    """The fields of a column of lists of structs, end to end, and the length of every list."""
    column = column.combine_chunks()
    flat = pc.list_flatten(column)
    return ([pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in names],
            pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))


def _first_of(lengths):
    """Where each list begins when they lie end to end; none is empty."""
    return np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)


def _held(px, py, edges, wall, first):
    """Which points (rows) the shapes' polygons hold; as ``geometry.point_in_polygon``. An edge without coordinates is never crossed."""
    crossed = wall & _spans(edges[1], edges[3], py) & _right_of(px, py, *edges)
    rim = np.logical_or.reduceat(wall & _on_edge(px, py, *edges), first, axis=1)
    return (np.add.reduceat(crossed, first, axis=1, dtype=np.int64) % 2 == 1) & ~rim


def _shape_distances(px, py, edges, wall, first):
    """Distance of every point (rows) to the nearest part of every shape, 0 inside a polygon; NaN if a shape has no edge."""
    dist = np.fmin.reduceat(_segment_distances(px, py, *edges), first, axis=1)
    return np.where(_held(px, py, edges, wall, first), 0.0, dist) if wall.any() else dist


def shapes_of_cell(radius, sides=None):
    """Rows ``place, kind, n, dist`` as of :func:`points_of_cell`, of shapes: in range if all their corners are.

    Shapes come with ``kind, copies, ox, oy, ext``, their ``corners`` and ``edges``, at least one of each; the last ``walls``
    edges are those of polygons.
    """
    sure_radius = g.sure_reach(radius, sides)

    def search(places, shapes):
        kind, kinds = _codes(shapes.column("kind"))
        order = np.argsort(kind, kind="stable")
        kind, shapes = kind[order], shapes.take(pa.array(order))
        ox, oy, ext, copies, walls = _floats(shapes, "ox", "oy", "ext", "copies", "walls")
        (vx, vy), corners = _lists(shapes.column("corners"), "x", "y")
        ends, edges = _lists(shapes.column("edges"), *EDGE)
        of_corner, of_edge = (np.repeat(np.arange(len(kind)), n) for n in (corners, edges))
        wall = np.arange(len(of_edge)) >= np.repeat(np.cumsum(edges) - walls, edges)
        whole = ~np.maximum.reduceat(np.isnan(vx) | np.isnan(vy), _first_of(corners))
        place, x, y = _floats(places, "place", "x", "y")

        def corners_of(chosen):
            at = chosen[of_corner]
            return vx[at], vy[at], _first_of(corners[chosen])

        def edges_of(chosen):
            at = chosen[of_edge]
            return [v[at] for v in ends], wall[at], _first_of(edges[chosen])

        out = []
        for rows in _blocks(x, y):
            px, py = x[rows], y[rows]
            cx, cy = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
            half = np.hypot(px - cx, py - cy).max() + SLACK
            near = np.hypot(ox - cx, oy - cy) < radius + half
            if not near.any():
                continue
            qx, qy, first = corners_of(near)
            far = np.full(len(kind), np.inf)
            far[near] = np.fmax.reduceat(np.hypot(qx - cx, qy - cy), first)
            near &= far < radius + half
            if not near.any():
                continue
            sure = near & whole & (far + half < sure_radius - SLACK)
            settled, best = np.zeros(len(kinds), np.int64), np.full(len(kinds), np.inf)
            np.add.at(settled, kind[sure], copies[sure])
            dist = np.full(len(kind), np.inf)
            dist[near] = _shape_distances(np.array([[cx]]), np.array([[cy]]), *edges_of(near))[0]
            known = sure & (dist < np.inf)
            np.minimum.at(best, kind[known], dist[known] + half)
            close = near & ~(dist - half > best[kind])
            tested = close | (near & ~sure)
            k, weight, nearest_too = kind[tested], np.where(sure, 0, copies)[tested], close[tested]
            qx, qy, first = corners_of(tested)
            chosen, is_wall, first_edge = edges_of(close)
            reached = sure_radius - SLACK - ext[tested]
            runs = _starts(k)
            for some in _chunks(rows, len(qx) + len(is_wall)):
                px, py = x[some, None], y[some, None]
                dx, dy = px - qx, py - qy
                d = np.sqrt(dx * dx + dy * dy)
                met = np.logical_and.reduceat(_in_reach(d, x[some], y[some], qx, qy, radius, sure_radius, sides), first, axis=1)
                met |= d[:, first] < reached
                n = np.add.reduceat(np.where(met, weight, 0), runs, axis=1) + settled[k[runs]]
                d = np.full(met.shape, np.inf)
                if nearest_too.any():
                    d[:, nearest_too] = _shape_distances(px, py, chosen, is_wall, first_edge)
                d = np.fmin.reduceat(np.where(met, d, np.inf), runs, axis=1)
                i, j = np.nonzero((n > 0) | (d < np.inf))
                out.append((place[some][i], k[runs][j], n[i, j], d[i, j]))
        if not out:
            return None
        place, code, n, dist = (np.concatenate(v) for v in zip(*out))
        return pa.table({"place": place, "kind": kinds.take(pa.array(code)), "n": n.astype(np.int64),
                         "dist": pa.array(dist, mask=~(dist < np.inf))})

    return search


def _segment_distances(px, py, x1, y1, x2, y2):
    """As :func:`hearthgrid.functions.geometry.segment_distance`, operation by operation."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        along = ((px - x1) * dx + (py - y1) * dy) / length
    t = np.minimum(1.0, np.maximum(0.0, np.where(length == 0, 0.0, along)))
    ox, oy = px - (x1 + t * dx), py - (y1 + t * dy)
    return np.sqrt(ox * ox + oy * oy)


def _edges_by_block(places, edges, key, radius, sure, counted, nearest=True, sides=None):
    """For some places at a time: their row numbers, distances to the shapes that are looked at, the numbers of these,
    which of them are still to be counted, which shapes are in range of all these places, and the shapes' keys.

    Without ``nearest`` only shapes are looked at that are still to be counted."""
    code, values = _codes(edges.column(key))
    order = np.argsort(code, kind="stable")
    code = code[order]
    ends = [v[order] for v in _floats(edges, *EDGE)]
    x, y = _floats(places, "x", "y")
    for rows in _blocks(x, y):
        px, py = x[rows], y[rows]
        cx, cy = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
        half = np.hypot(px - cx, py - cy).max() + SLACK
        from_centre = _segment_distances(cx, cy, *ends)
        near = np.flatnonzero(from_centre <= radius + half)
        if not len(near):
            continue
        c, d = code[near], from_centre[near]
        tested = (d <= d.min() + 2 * half) & nearest
        settled = np.zeros(len(values), bool)
        if counted:
            settled[c[d + half < sure]] = True
            tested |= ~settled[c]
        near, c = near[tested], c[tested]
        first = _starts(c) if len(c) else np.zeros(0, np.int64)
        chosen = [v[near] for v in ends]
        for some in _chunks(rows, len(c)):
            dist = np.zeros((len(some), 0))
            if len(c):
                dist = _touching(_segment_distances(x[some, None], y[some, None], *chosen), x[some], y[some], chosen, radius, sure, sides)
                dist = np.minimum.reduceat(dist, first, axis=1)
            yield some, dist, c[first], ~settled[c[first]], settled, values


def roads_of_cell(key, radius, weight=None, nearest=True, sides=None):
    """Rows ``place, n, ties, dist``: the shapes in range, those tied for nearest and their distance.

    A shape counts as the value of its column ``weight``, one if there is none. ``sides`` counts shapes that touch the
    polygon drawn in the circle. Without ``nearest`` only ``n`` is meant.
    """
    sure = g.sure_reach(radius, sides)

    def search(places, edges):
        place, = _floats(places, "place")
        counts = np.ones(edges.num_rows, np.int64)
        if weight is not None:
            counts[_codes(edges.column(key))[0]] = edges.column(weight).to_numpy()
        out = []
        for some, dist, codes, open_, settled, _ in _edges_by_block(places, edges, key, radius, sure, True, nearest, sides):
            n = ((dist <= radius) & open_) @ counts[codes] + counts[:len(settled)][settled].sum()
            best = dist.min(axis=1, initial=np.inf)
            ties = (dist == best[:, None]).sum(axis=1)
            met = (best <= radius) | (n > 0)
            out.append((place[some][met], n[met], ties[met], best[met]))
        if not out:
            return None
        place, n, ties, dist = (np.concatenate(v) for v in zip(*out))
        return pa.table({"place": place, "n": n.astype(np.int64), "ties": ties.astype(np.int64), "dist": dist})

    return search


ROAD_ROWS = "place bigint, n bigint, ties bigint, dist double"


def nearest_of_cell(query_key, key, radius):
    """Rows of ``query_key``, ``key`` and ``dist``: each shape tied for nearest of a point."""

    def search(points, edges):
        out = []
        for some, dist, codes, _, _, values in _edges_by_block(points, edges, key, radius, radius, False):
            nearest = dist.min(axis=1)
            i, j = np.nonzero((dist == nearest[:, None]) & (nearest <= radius)[:, None])
            out.append((some[i], codes[j], dist[i, j]))
        if not out:
            return None
        row, code, dist = (np.concatenate(v) for v in zip(*out))
        return _paired(points, row, query_key, {key: values.take(pa.array(code)), "dist": pa.array(dist)})

    return search


def _paired(points, rows, names, more):
    taken = points.select(names).take(pa.array(rows))
    for name, values in more.items():
        taken = taken.append_column(name, values)
    return taken


# --- polygons ---------------------------------------------------------------------
#
# Twins of the tests in functions/geometry.py, for a column of points against a row of edges.


def _turn(px, py, x1, y1, x2, y2):
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def _spans(a, b, at):
    return (a > at) != (b > at)


def _right_of(px, py, x1, y1, x2, y2):
    side = _turn(px, py, x1, y1, x2, y2)
    beyond = np.where(y2 > y1, side > 0, side < 0)
    return ((x1 > px) & (x2 > px)) | (~((x1 <= px) & (x2 <= px)) & beyond)


def _above(px, py, x1, y1, x2, y2):
    side = _turn(px, py, x1, y1, x2, y2)
    beyond = np.where(x2 > x1, (side < 0) | ((side == 0) & (y2 > y1)), (side > 0) | ((side == 0) & (y2 < y1)))
    return ((y1 > py) & (y2 > py)) | (~((y1 <= py) & (y2 <= py)) & beyond)


def _on_edge(px, py, x1, y1, x2, y2):
    return ((_turn(px, py, x1, y1, x2, y2) == 0) & (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2))
            & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2)))


def _touching(dist, px, py, edges, radius, sure, sides):
    """Distances, infinite where the edge does not touch the search region; see ``geometry.segment_in_reach``."""
    if sides is None:
        return dist
    i, j = np.nonzero((dist > sure) & (dist <= radius))
    ax, ay, bx, by = edges[0][j] - px[i], edges[1][j] - py[i], edges[2][j] - px[i], edges[3][j] - py[i]
    low, high = np.zeros(len(i)), np.ones(len(i))
    for k in range(sides):
        c, s = math.cos((2 * k + 1) * (math.pi / sides)), math.sin((2 * k + 1) * (math.pi / sides))
        a, b = c * ax + s * ay, c * bx + s * by
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = (sure - a) / (b - a)
        low = np.maximum(low, np.where(b < a, cut, np.where((b == a) & (a > sure), 2.0, 0.0)))
        high = np.minimum(high, np.where(b > a, cut, 1.0))
    dist[dist > radius] = np.inf
    dist[i[low > high], j[low > high]] = np.inf
    return dist


def polygons_of_cell(query_key, key, radius, size, sides=None, counted=False):
    """Rows of ``query_key``, ``key``, ``inside`` and ``dist`` for every point and polygon that meet, or, if ``counted``,
    of ``query_key`` and ``n``, the number of polygons.

    ``core`` tells covered centres from edges. The way from a point to the centre of its cell goes along x, then along y.
    """
    sure = g.sure_reach(radius, sides)

    def search(points, pieces):
        code, values = _codes(pieces.column(key))
        core = pieces.column("core").to_numpy() == 1
        cores = np.bincount(code[core], minlength=len(values))
        order = np.flatnonzero(~core)[np.argsort(code[~core], kind="stable")]
        wall, edges = code[order], [v[order] for v in _floats(pieces, *EDGE)]
        x, y = _floats(points, "x", "y")
        cx, cy = ((points.column(c)[0].as_py() + 0.5) * size for c in CELL)
        left, right = np.minimum(edges[0], edges[2]), np.maximum(edges[0], edges[2])
        low, high = np.minimum(edges[1], edges[3]), np.maximum(edges[1], edges[3])
        out = []
        for rows in _blocks(x, y):
            x0, x1, y0, y1 = x[rows].min(), x[rows].max(), y[rows].min(), y[rows].max()
            tested = (left <= max(x1, cx)) & (right >= min(x0, cx)) & (low <= y1) & (high >= y0)
            tested |= (left <= cx) & (right >= cx) & (low <= max(y1, cy)) & (high >= min(y0, cy))
            if radius > 0:
                half = math.hypot(x1 - x0, y1 - y0) / 2 + SLACK
                tested |= _segment_distances((x0 + x1) / 2, (y0 + y1) / 2, *edges) <= radius + half
            c, chosen = wall[tested], [v[tested] for v in edges]
            # Polygons that cover the centre and have no edge to be tested hold the whole block.
            whole = cores % 2 == 1
            whole[c] = False
            whole, first = np.flatnonzero(whole), _starts(c) if len(c) else np.zeros(0, np.int64)
            for some in _chunks(rows, len(c)):
                n = np.full(len(some), len(whole))
                if not counted:
                    out.append((np.repeat(some, len(whole)), np.tile(whole, len(some)),
                                np.ones(len(some) * len(whole), bool), np.zeros(len(some) * len(whole))))
                if len(c):
                    px, py = x[some, None], y[some, None]
                    crossed = (_spans(chosen[1], chosen[3], py) & (_right_of(px, py, *chosen) != _right_of(cx, py, *chosen))).astype(np.int8)
                    crossed += _spans(chosen[0], chosen[2], cx) & (_above(cx, py, *chosen) != _above(cx, cy, *chosen))
                    rim = np.logical_or.reduceat(_on_edge(px, py, *chosen), first, axis=1)
                    crossed = np.add.reduceat(crossed, first, axis=1, dtype=np.int64) + cores[c[first]]
                    inside = (crossed % 2 == 1) & ~rim
                    dist = _touching(_segment_distances(px, py, *chosen), x[some], y[some], chosen, radius, sure, sides)
                    dist = np.where(inside, 0.0, np.minimum.reduceat(dist, first, axis=1))
                    met = inside | (dist <= radius) if radius > 0 else inside
                    if counted:
                        n = n + met.sum(axis=1)
                    else:
                        i, j = np.nonzero(met)
                        out.append((some[i], c[first][j], inside[i, j], dist[i, j]))
                if counted:
                    out.append((some[n > 0], n[n > 0]))
        if not out:
            return None
        row, *found = (np.concatenate(v) for v in zip(*out))
        if counted:
            return _paired(points, row, query_key, {"n": pa.array(found[0].astype(np.int64))})
        return _paired(points, row, query_key, {
            key: values.take(pa.array(found[0])), "inside": pa.array(found[1]), "dist": pa.array(found[2])})

    return search
