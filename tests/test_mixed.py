"""Layers that hold points, lines and polygons side by side, and search regions drawn as polygons."""

import json
import math

import pytest
import shapes
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as g
from hearthgrid.layer import Layer
from hearthgrid.operators import neighbours as nb
from hearthgrid.operators import poi_shapes
from hearthgrid.operators.spatial_join import polygons_at
from hearthgrid.sources import geojson

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
MIXED = f"STRUCT<kind: STRING, points: ARRAY<{POINT}>, lines: ARRAY<ARRAY<{POINT}>>, polygons: ARRAY<ARRAY<ARRAY<{POINT}>>>>"


def mixed(kind, points=(), lines=(), polygons=()):
    return {"kind": kind, "points": list(points), "lines": list(lines), "polygons": list(polygons)}


def random_shape(rng, span, size):
    x, y = rng.uniform(-span, span), rng.uniform(-span, span)
    near = [shapes.pt(x + rng.uniform(-size, size), y + rng.uniform(-size, size)) for _ in range(rng.randint(2, 5))]
    way = rng.randrange(5)
    if way == 0:
        return mixed("Point", [shapes.pt(x, y)])
    if way == 1:
        return mixed("MultiPoint", near)
    if way == 2:
        return mixed("LineString", lines=[near])
    rings = [shapes.ring(shapes.star(rng, x, y, size, 7))]
    if way == 3:
        return mixed("Polygon", polygons=[rings])
    return mixed("GeometryCollection", near[:1], [near], [rings])


def parts(shape):
    segments = [(p["x"], p["y"], p["x"], p["y"]) for p in shape["points"]]
    segments += [(a["x"], a["y"], b["x"], b["y"]) for ln in shape["lines"] for a, b in zip(ln, ln[1:])]
    return segments + shapes.edges(shape["polygons"])


def corners(shape):
    return [(e[0], e[1]) for e in parts(shape)] + [(e[2], e[3]) for e in parts(shape)]


def beyond(x, y, sides):
    """How far a point lies from the middle of a regular polygon, in the direction of the side it faces."""
    return max(math.cos((2 * k + 1) * math.pi / sides) * x + math.sin((2 * k + 1) * math.pi / sides) * y for k in range(sides))


def expected(px, py, rows, radius, sides=None):
    found = {}
    for _, kind, shape in rows:
        if sides is None:
            inside = all(math.hypot(x - px, y - py) < radius for x, y in corners(shape))
        else:
            inside = all(beyond(x - px, y - py, sides) < radius * math.cos(math.pi / sides) for x, y in corners(shape))
        if inside:
            dist = min(shapes.segment_distance(px, py, e) for e in parts(shape))
            if shape["polygons"] and shapes.inside(px, py, shape["polygons"]):
                dist = 0.0
            n, best = found.get(kind, (0, math.inf))
            found[kind] = (n + 1, min(best, dist))
    return found


@pytest.mark.parametrize("sides", [None, 8])
@pytest.mark.parametrize("budget", [10**9, 1])
def test_any_kind_of_poi_against_brute_force(spark, budget, sides):
    rng = shapes.rng(3)
    rows = [(i, rng.choice(["a", "b"]), random_shape(rng, 1500, rng.choice([5, 60, 300, 700]))) for i in range(120)]
    homes = [(i, shapes.pt(rng.uniform(-1500, 1500), rng.uniform(-1500, 1500))) for i in range(60)]
    pois = Layer(spark.createDataFrame(rows, f"poi_id bigint, poi_type string, shape {MIXED}"), "poi_id", "shape", "mixed", 3857)
    buildings = Layer(spark.createDataFrame(homes, f"building_id bigint, spot {POINT}"), "building_id", "spot", "point", 3857)
    out = nb.poi_features(buildings, pois, 500.0, budget=budget, sides=sides)
    got = {r["building_id"]: r for r in out.collect()}
    hits = 0
    for i, spot in homes:
        want = expected(spot["x"], spot["y"], rows, 500.0, sides)
        for kind in ("a", "b"):
            n, dist = want.get(kind, (0, None))
            hits += n
            assert got[i][f"count_{kind}"] == n
            assert got[i][f"nearest_{kind}_dist"] == (None if dist is None else pytest.approx(dist, abs=1e-9))
    assert hits > 100


def test_crowded_shapes_are_searched_on_finer_grids(spark, monkeypatch):
    """With few pairs allowed per cell the search has to go down, and finds the same."""
    monkeypatch.setattr(poi_shapes, "SMALL", 30)
    rng = shapes.rng(8)
    rows = [(i, "a", random_shape(rng, 300, 60)) for i in range(60)]
    homes = [(i, shapes.pt(rng.uniform(-400, 400), rng.uniform(-400, 400))) for i in range(60)]
    pois = Layer(spark.createDataFrame(rows, f"poi_id bigint, poi_type string, shape {MIXED}"), "poi_id", "shape", "mixed", 3857)
    buildings = Layer(spark.createDataFrame(homes, f"building_id bigint, spot {POINT}"), "building_id", "spot", "point", 3857)
    got = {r["building_id"]: r for r in nb.poi_features(buildings, pois, 300.0, budget=1).collect()}
    for i, spot in homes:
        n, dist = expected(spot["x"], spot["y"], rows, 300.0).get("a", (0, None))
        assert got[i]["count_a"] == n and got[i]["nearest_a_dist"] == (None if dist is None else pytest.approx(dist, abs=1e-9))


@pytest.mark.parametrize("search", [poi_shapes.shape_pairs, poi_shapes.crowded_shape_rows])
def test_shapes_are_counted_for_blocks_of_places_not_pair_by_pair(spark, search):
    """A row per place, kind and cell, however many shapes there are; also for shapes without an edge."""
    rng = shapes.rng(13)
    rows = [(i, rng.choice(["a", "b"]), random_shape(rng, 200, 40)) for i in range(80)]
    rows += [(i, "c", mixed("Polygon", polygons=[[[shapes.pt(10 * i, 0)]]])) for i in range(5)]
    spots = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(40)]
    pois = Layer(spark.createDataFrame(rows, f"poi_id bigint, poi_type string, shape {MIXED}"), "poi_id", "shape", "mixed", 3857)
    found = search(spark.createDataFrame(spots, "place bigint, x double, y double"), poi_shapes.shape_table(pois, 350.0), 350.0, 1000.0).collect()
    assert len(found) <= 40 * 3 * 2
    for i, x, y in spots:
        want = expected(x, y, rows[:80], 350.0)
        for kind in "ab":
            met = [r for r in found if r["place"] == i and r["kind"] == kind]
            n, dist = want.get(kind, (0, math.inf))
            assert sum(r["n"] for r in met) == n
            assert min([r["dist"] for r in met if r["dist"] is not None], default=math.inf) == pytest.approx(dist, abs=1e-9)
        lone = [r for r in found if r["place"] == i and r["kind"] == "c"]
        assert sum(r["n"] for r in lone) == sum(math.hypot(10 * k - x, y) < 350 for k in range(5))
        assert all(r["dist"] is None for r in lone)


def test_shapes_wider_than_the_region_never_reach_the_join(spark):
    rows = [(1, "a", mixed("LineString", lines=[[shapes.pt(0, 0), shapes.pt(999, 0)]])),
            (2, "a", mixed("LineString", lines=[[shapes.pt(0, 0), shapes.pt(1000, 0)]])), (3, "a", None)]
    pois = Layer(spark.createDataFrame(rows, f"poi_id bigint, poi_type string, shape {MIXED}"), "poi_id", "shape", "mixed", 3857)
    table = poi_shapes.shape_table(pois, 500.0)
    assert [(r["ox"], r["oy"], r["ext"]) for r in table.collect()] == [(0.0, 0.0, 999.0)]


def test_too_many_types_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(nb, "MOST_TYPES", 3)
    df = spark.range(4).selectExpr("CAST(id AS STRING) AS poi_type")
    with pytest.raises(ValueError, match="more than 3 POI types"):
        nb.poi_types(df)
    assert nb.poi_types(df.filter("poi_type < 3")) == ["0", "1", "2"]


FEATURES = [
    {"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4, 9]]},
    {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]},
    {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [7, 8]}, {"type": "LineString", "coordinates": [[0, 0], [4, 0]]}]},
    None, {"type": "Point", "coordinates": []}]


def write_features(path, geometries):
    with open(path, "w") as out:
        for i, shape in enumerate(geometries):
            out.write(json.dumps({"type": "Feature", "properties": {"k": i}, "geometry": shape}) + "\n")


def test_all_types_are_read_and_written_as_they_were(spark, tmp_path):
    write_features(tmp_path / "shop.geojson", FEATURES)
    layer = geojson.read_poi_folder(spark, str(tmp_path), "k")
    got = {r["k"]: r["geometry"] for r in layer.df.collect()}
    assert got[7] is None and got[8] is None and [got[i]["kind"] for i in range(7)] == [f["type"] for f in FEATURES[:7]]
    assert [len(got[i]["points"]) for i in range(7)] == [1, 2, 0, 0, 0, 0, 1]
    assert [len(got[i]["lines"]) for i in range(7)] == [0, 0, 1, 2, 0, 0, 1] and len(got[5]["polygons"]) == 2
    geojson.write_geojson(layer, str(tmp_path / "again"))
    back = geojson.read_geojson_layer(spark, str(tmp_path / "again"), "k", "mixed")
    assert {r["k"]: r["geometry"] for r in back.df.collect()} == got
    spots = {r["k"]: (r["x"], r["y"]) for r in layer.located().collect()}
    assert spots[0] == (1, 2) and spots[1] == (2, 3) and spots[2] == (0.5, 0.5) and spots[6] == (2, 0) and spots[7] == (None, None)
    assert spots[4] == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    moved = layer.to_srid(3857).to_srid(4326).df.filter("k = 5").first()["geometry"]["polygons"][1][0][2]
    assert (moved["x"], moved["y"]) == (pytest.approx(6), pytest.approx(6))


def test_unknown_types_are_refused(spark, tmp_path):
    write_features(tmp_path / "a.geojson", [{"type": "Sphere", "coordinates": [1]}])
    with pytest.raises(Exception, match="unknown geometry type Sphere"):
        geojson.read_geojson(spark, str(tmp_path / "a.geojson"), "mixed").collect()


def test_layers_of_different_kinds_unite(spark):
    points = Layer(spark.createDataFrame([(1, shapes.pt(0, 0))], f"k bigint, geom {POINT}"), "k", "geom", "point", 3857)
    lines = Layer(spark.createDataFrame([(2, [shapes.pt(0, 0), shapes.pt(1, 1)])], f"k bigint, geom ARRAY<{POINT}>"), "k", "geom", "line", 3857)
    both = geojson.union_poi_layers(points, lines)
    assert both.kind == "mixed" and {r["k"]: r["geom"]["kind"] for r in both.df.collect()} == {1: "Point", 2: "MultiLineString"}
    assert geojson.union_poi_layers(points, points).kind == "point"


@pytest.mark.parametrize("sides", [3, 64])
def test_segments_meet_a_regular_polygon(spark, sides):
    """Against the polygon's distance along the segment, which is convex and so has one lowest stretch."""
    rng = shapes.rng(5)
    rows = []
    for _ in range(400):
        x, y, turn, size = rng.uniform(-14, 14), rng.uniform(-14, 14), rng.uniform(0, 7), rng.uniform(0.01, 20)
        rows.append((x, y, x + size * math.cos(turn), y + size * math.sin(turn)))
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    dist = g.segment_distance("0D", "0D", *g.EDGE)
    got = [r[0] for r in df.select(F.expr(g.segment_in_reach(dist, "0D", "0D", *g.EDGE, 10.0, sides))).collect()]
    for hit, (x1, y1, x2, y2) in zip(got, rows):
        lo, hi = 0.0, 1.0
        for _ in range(100):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            at = [beyond(x1 + t * (x2 - x1), y1 + t * (y2 - y1), sides) for t in (a, b)]
            lo, hi = (lo, b) if at[0] < at[1] else (a, hi)
        lowest = beyond(x1 + lo * (x2 - x1), y1 + lo * (y2 - y1), sides)
        limit = 10 * math.cos(math.pi / sides)
        assert abs(lowest - limit) < 1e-6 or hit == (lowest <= limit)
    assert 50 < sum(got) < 350


def test_a_polygon_around_the_region_counts(spark):
    around = shapes.ring([(-900, -900), (900, -900), (900, 900), (-900, 900)])
    water = Layer(spark.createDataFrame([(1, [around])], f"w bigint, shape ARRAY<ARRAY<{POINT}>>"), "w", "shape", "polygon", 3857)
    spots = spark.createDataFrame([(1, 0.0, 0.0), (2, 950.0, 0.0), (3, 1399.9, 0.0), (4, 1400.1, 0.0)], "place bigint, x double, y double")
    met = polygons_at(spots, ["place"], water, 500.0, sides=64)
    assert sorted(r["place"] for r in met.collect()) == [1, 2, 3]
