import math

import pytest

from hearthgrid import Layer
from hearthgrid.functions import crs, geometry as g
from tests import shapes

POLYGON = "id bigint, geom array<array<array<struct<x:double,y:double>>>>"
LINE = "id bigint, geom array<array<struct<x:double,y:double>>>"


def layer(spark, rows, kind="polygon", schema=POLYGON):
    return Layer(spark.createDataFrame(rows, schema), "id", "geom", kind, 3857)


def numeric_centroid(multi):
    """By the triangles from the origin; holes are drawn the other way round."""
    a = mx = my = 0.0
    for rings in multi:
        for k, rg in enumerate(rings):
            ra = rx = ry = 0.0
            for p, q in zip(rg, rg[1:]):
                c = p["x"] * q["y"] - q["x"] * p["y"]
                ra, rx, ry = ra + c / 2, rx + (p["x"] + q["x"]) * c / 6, ry + (p["y"] + q["y"]) * c / 6
            s = (1 if ra > 0 else -1) * (1 if k == 0 else -1)
            a, mx, my = a + s * ra, mx + s * rx, my + s * ry
    return mx / a, my / a


def test_centroid_of_concave_shapes_with_holes_and_parts(spark):
    rng = shapes.rng(1)
    rows = [(i, shapes.polygon(rng, 100.0)) for i in range(60)]
    for r in layer(spark, rows).located().collect():
        want = numeric_centroid(rows[r["id"]][1])
        assert r["x"] == pytest.approx(want[0], abs=1e-6)
        assert r["y"] == pytest.approx(want[1], abs=1e-6)


def test_inner_point_is_inside_where_the_centroid_is_not(spark):
    u = [[shapes.ring([(0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (1, 1), (1, 10), (0, 10)])]]
    rng = shapes.rng(2)
    rows = [(0, u)] + [(i, shapes.polygon(rng, 100.0)) for i in range(1, 60)]
    lay = layer(spark, rows)
    spot = {r["id"]: (r["x"], r["y"]) for r in lay.located(inner=True).collect()}
    for i, multi in rows:
        assert shapes.inside(*spot[i], multi)
    middle = lay.located().filter("id = 0").first()
    assert not shapes.inside(middle["x"], middle["y"], u)


def test_degenerate_null_and_empty_shapes(spark):
    flat = [[shapes.ring([(0, 0), (4, 0), (2, 0)])]]
    rows = [(0, flat), (1, None), (2, []), (3, [[]])]
    got = {r["id"]: (r["x"], r["y"]) for r in layer(spark, rows).located().collect()}
    assert got[0] == (2.0, 0.0)
    assert got[1] == got[2] == got[3] == (None, None)


def test_line_centroid_weighs_by_length(spark):
    bent = [[shapes.pt(0, 0), shapes.pt(10, 0), shapes.pt(10, 2)]]
    dot = [[shapes.pt(5, 7)]]
    got = {r["id"]: (r["x"], r["y"]) for r in layer(spark, [(0, bent), (1, dot)], "line", LINE).located().collect()}
    assert got[0] == (pytest.approx((5 * 10 + 10 * 2) / 12), pytest.approx(2 / 12))
    assert got[1] == (5.0, 7.0)


def test_point_in_polygon_matches_plain_ray_casting(spark):
    rng = shapes.rng(3)
    rows, want = [], []
    for i in range(400):
        multi = shapes.polygon(rng, 50.0)
        x, y = rng.uniform(-10, 200), rng.uniform(-10, 60)
        rows.append((i, multi, x, y))
        want.append(shapes.inside(x, y, multi))
    df = spark.createDataFrame(rows, POLYGON + ", x double, y double")
    got = df.selectExpr("id", f"{g.point_in_polygon('x', 'y', 'geom')} AS hit",
                        f"{g.point_geometry_distance('x', 'y', 'geom', 'polygon')} AS d").collect()
    for r in got:
        _, multi, x, y = rows[r["id"]]
        assert r["hit"] == want[r["id"]]
        rim = min(shapes.segment_distance(x, y, e) for e in shapes.edges(multi))
        assert r["d"] == pytest.approx(0.0 if want[r["id"]] else rim, abs=1e-9)


def test_boundary_counts_as_outside(spark):
    square = [[shapes.ring([(0, 0), (4, 0), (4, 4), (0, 4)])]]
    spots = [(0, 0), (2, 0), (4, 2), (2, 4), (0, 2), (4, 4), (2, 2)]
    df = spark.createDataFrame([(i, square, float(x), float(y)) for i, (x, y) in enumerate(spots)],
                               POLYGON + ", x double, y double")
    got = [r[0] for r in df.orderBy("id").selectExpr(g.point_in_polygon("x", "y", "geom")).collect()]
    assert got == [False] * 6 + [True]


def test_mercator_and_utm_round_trips(spark):
    rng = shapes.rng(4)
    rows = [(rng.uniform(-179.9, 179.9), rng.uniform(-80, 80)) for _ in range(500)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    mx, my = crs.to_mercator("lon", "lat")
    df = df.selectExpr("*", f"{mx} AS mx", f"{my} AS my", f"{crs.utm_srid('lon', 'lat')} AS srid")
    ux, uy = crs.to_utm("lon", "lat", "srid")
    df = df.selectExpr("*", f"{ux} AS ux", f"{uy} AS uy")
    a, b = crs.from_mercator("mx", "my")
    c, d = crs.from_utm("ux", "uy", "srid")
    for r in df.selectExpr("*", f"{a} AS a", f"{b} AS b", f"{c} AS c", f"{d} AS d").collect():
        assert (r["a"], r["b"]) == (pytest.approx(r["lon"], abs=1e-11), pytest.approx(r["lat"], abs=1e-11))
        assert (r["c"], r["d"]) == (pytest.approx(r["lon"], abs=1e-9), pytest.approx(r["lat"], abs=1e-9))
        assert 32601 <= r["srid"] <= 32760


def test_utm_agrees_with_the_power_series(spark):
    """The older series in powers of the longitude difference, good to millimetres in a zone."""
    rng = shapes.rng(5)
    rows = [(rng.uniform(114.5, 119.5), rng.uniform(0.5, 60)) for _ in range(200)]
    x, y = crs.to_utm("lon", "lat", "32650")
    df = spark.createDataFrame(rows, "lon double, lat double").selectExpr("*", f"{x} AS x", f"{y} AS y")
    e2 = 0.0066943799901413165
    ep2 = e2 / (1 - e2)
    for r in df.collect():
        phi, lam = math.radians(r["lat"]), math.radians(r["lon"] - 117)
        n = 6378137 / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        t, c, a = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, math.cos(phi) * lam
        m = 6378137 * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
                       - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
                       + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi)
                       - 35 * e2**3 / 3072 * math.sin(6 * phi))
        east = 500000 + 0.9996 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a**5 / 120)
        north = 0.9996 * (m + n * math.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24
                          + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a**6 / 720))
        assert r["x"] == pytest.approx(east, abs=0.01)
        assert r["y"] == pytest.approx(north, abs=0.01)


def test_layers_without_a_system_or_column_are_refused(spark):
    df = spark.createDataFrame([(1, None)], POLYGON)
    with pytest.raises(ValueError, match="missing required columns"):
        Layer(df, "id", "shape", "polygon", 3857)
    with pytest.raises(ValueError, match="no reference system"):
        Layer(df, "id", "geom", "polygon", None).projected()
    with pytest.raises(ValueError, match="unsupported"):
        Layer(df, "id", "geom", "polygon", 3035).projected()
