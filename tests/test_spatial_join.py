import math

import pytest
from pyspark.sql import functions as F

from hearthgrid import Layer
from hearthgrid.operators import areas, cells, crowded, skew
from hearthgrid.operators import neighbours as nb
from hearthgrid.operators import spatial_join as sj
from tests import shapes
from tests.test_geometry import LINE, POLYGON


def spots(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)],
                                 "qid bigint, x double, y double")


@pytest.mark.parametrize("size", [3.0, 11.0, 500.0])
@pytest.mark.parametrize("radius", [0.0, 4.0])
def test_polygons_match_brute_force(spark, size, radius):
    rng = shapes.rng(int(size * 10 + radius))
    polys = [shapes.polygon(rng, 40.0) for _ in range(25)]
    points = [(rng.uniform(-10, 170), rng.uniform(-10, 60)) for _ in range(150)]
    lay = Layer(spark.createDataFrame(list(enumerate(polys)), POLYGON), "id", "geom", "polygon", 3857)
    got = {(r["qid"], r["id"]): (r["inside"], r["dist"])
           for r in sj.polygons_at(spots(spark, points), ["qid"], lay, radius, size).collect()}
    want = {}
    for q, (x, y) in enumerate(points):
        for p, multi in enumerate(polys):
            within = shapes.inside(x, y, multi)
            d = 0.0 if within else min(shapes.segment_distance(x, y, e) for e in shapes.edges(multi))
            if within or (radius > 0 and d <= radius):
                want[q, p] = (within, d)
    assert got.keys() == want.keys()
    for k, (within, d) in want.items():
        assert got[k] == (within, pytest.approx(d, abs=1e-9))


@pytest.mark.parametrize("size", [1.0, 2.0, 4.0, 6.0])
def test_polygons_on_a_lattice_with_points_on_corners_edges_and_centres(spark, size):
    """Vertices, edges, cell borders and cell centres all coincide here."""
    rng = shapes.rng(int(size))
    polys = [shapes.polygon(rng, 16.0, grid=1.0) for _ in range(30)]
    points = [(x / 2, y / 2) for x in range(-2, 40, 1) for y in range(-2, 36, 3)]
    lay = Layer(spark.createDataFrame(list(enumerate(polys)), POLYGON), "id", "geom", "polygon", 3857)
    got = {(r["qid"], r["id"]) for r in sj.polygons_at(spots(spark, points), ["qid"], lay, 0.0, size).collect()}
    want = set()
    for q, (x, y) in enumerate(points):
        for p, multi in enumerate(polys):
            # Lattice rings may run back over themselves; the turn test is exact on these numbers.
            es = shapes.edges(multi)
            rim = any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2)
                      and min(y1, y2) <= y <= max(y1, y2) for x1, y1, x2, y2 in es)
            hits = sum((y1 > y) != (y2 > y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x
                       for x1, y1, x2, y2 in es)
            if hits % 2 and not rim:
                want.add((q, p))
    assert got == want


def test_upright_and_long_edges_reach_every_cell(spark):
    lines = [[[shapes.pt(5, 0), shapes.pt(5, 100)]], [[shapes.pt(0, 50), shapes.pt(100, 50)]],
             [[shapes.pt(0, 0), shapes.pt(100, 97)]], [[shapes.pt(100, 3), shapes.pt(0, 88)]],
             [[shapes.pt(40, 40)]]]
    rng = shapes.rng(8)
    points = [(rng.uniform(-5, 105), rng.uniform(-5, 105)) for _ in range(300)]
    lay = Layer(spark.createDataFrame(list(enumerate(lines)), LINE), "id", "geom", "line", 3857)
    found = sj.edges_within(spots(spark, points), cells.explode_edges(lay), 3.0, 7.0)
    got = {(r["qid"], r["id"]): r["dist"] for r in found.collect()}
    want = {}
    for q, (x, y) in enumerate(points):
        for p, (path,) in enumerate(lines):
            ends = list(zip(path, path[1:])) or [(path[0], path[0])]
            d = min(shapes.segment_distance(x, y, (a["x"], a["y"], b["x"], b["y"])) for a, b in ends)
            if d <= 3.0:
                want[q, p] = d
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_points_within_is_strict_and_survives_repartitioning(spark):
    rng = shapes.rng(9)
    a = [(0, 0), (30, 40)] + [(rng.uniform(-100, 100), rng.uniform(-100, 100)) for _ in range(200)]
    b = [(50, 0), (30, 39)] + [(rng.uniform(-100, 100), rng.uniform(-100, 100)) for _ in range(200)]
    left = spots(spark, a)
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "pid bigint, ox double, oy double")

    def run(left, right, **kw):
        return {(r["qid"], r["pid"]) for r in sj.points_within(left, right, 50.0, **kw).collect()}

    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.dist(p, q) < 50.0}
    assert run(left, right, size=20.0) == run(left.repartition(7), right.repartition(3), size=130.0) == want
    assert (0, 0) not in want and (0, 0) in run(left, right, inclusive=True)


def test_crowded_cells_are_split_without_losing_or_repeating_pairs(spark):
    rng = shapes.rng(10)
    a = spots(spark, [(rng.gauss(5, 1), rng.gauss(5, 1)) for _ in range(300)])
    b = spark.createDataFrame([(i, rng.gauss(5, 1), rng.gauss(5, 1)) for i in range(300)], "pid bigint, ox double, oy double")
    left, right = cells.with_cell(a, "x", "y", 10.0), cells.spread_points(b, "ox", "oy", 2.0, 10.0)
    assert skew.hot_cells(left, right, 1000).first()["parts"] > 1
    split = skew.join_cells(left, right, ["x", "y"], 1000).select("qid", "pid")
    plain = left.join(right, ["gx", "gy"]).select("qid", "pid")
    assert sorted(split.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("small", [1, 40, 10**9])
def test_crowded_search_matches_brute_force(spark, small):
    rng = shapes.rng(11)

    def cloud(n):
        dense = [(rng.gauss(300, 40), rng.gauss(-200, 40)) for _ in range(n // 2)]
        pile = [(300.0, -200.0)] * 5 + [(800.0, -200.0)] * 3
        return list(dict.fromkeys(dense + pile + [(rng.uniform(-900, 1500), rng.uniform(-900, 900)) for _ in range(n // 2)]))

    a, b = cloud(150), [(p, rng.choice("uv"), rng.randint(1, 4)) for p in cloud(200)]
    queries = spots(spark, a).withColumnRenamed("qid", "place")
    objects = spark.createDataFrame([(x, y, k, n) for (x, y), k, n in b], "ox double, oy double, kind string, copies bigint")
    rows = crowded.crowded_rows(queries, objects, 500.0, 1000.0, small)
    got = {(*a[r["place"]], r["kind"]): (r["n"], r["d"]) for r in
           rows.groupBy("place", "kind").agg(F.sum("n").alias("n"), F.min("dist").alias("d")).collect()}
    want = {}
    for x, y in a:
        for kind in "uv":
            near = [(math.sqrt((x - p[0]) ** 2 + (y - p[1]) ** 2), n) for p, k, n in b if k == kind]
            near = [(d, n) for d, n in near if d < 500.0]
            if near:
                want[x, y, kind] = (sum(n for _, n in near), min(d for d, _ in near))
    assert got.keys() == want.keys()
    for k, (n, d) in want.items():
        assert got[k] == (n, pytest.approx(d, abs=1e-9))


@pytest.mark.parametrize("sides", [None, 5])
def test_near_rows_gives_the_same_with_and_without_crowding(spark, sides):
    rng = shapes.rng(12)
    where = nb.places(spots(spark, [(rng.gauss(0, 300), rng.gauss(0, 300)) for _ in range(200)]))
    objects = spark.createDataFrame([(rng.gauss(0, 300), rng.gauss(0, 300), rng.choice("uv"), 2) for _ in range(300)],
                                    "ox double, oy double, kind string, copies bigint")

    def run(budget):
        rows = nb.near_rows(where, objects, 500.0, 250.0, budget, sides)
        out = rows.groupBy("place", "kind").agg({"n": "sum", "dist": "min"}).collect()
        return {(r["place"], r["kind"]): (r["sum(n)"], round(r["min(dist)"], 9)) for r in out}

    assert run(10**9) == run(2000) == run(1)


@pytest.mark.parametrize("budget", [10**9, 2000, 1])
def test_water_counts_match_brute_force_in_crowded_cells(spark, budget, monkeypatch):
    monkeypatch.setattr(crowded.crowded_polygon_counts, "__defaults__", (60, None))
    rng = shapes.rng(14)
    polys = [shapes.polygon(rng, 400.0) for _ in range(40)]
    polys += [[[shapes.ring([(-900, -900), (2000, -900), (2000, 1500), (-900, 1500)])]]] * 2
    lay = Layer(spark.createDataFrame(list(enumerate(polys)), POLYGON), "id", "geom", "polygon", 3857)
    where = nb.places(spots(spark, [(rng.gauss(200, 250), rng.gauss(200, 250)) for _ in range(200)] + [(5000, 5000)]))
    got = {r["place"]: r["count_water"] for r in nb.water_counts(where, lay, 60.0, 120.0, budget).collect()}
    want = {}
    for r in where.collect():
        n = sum(shapes.inside(r["x"], r["y"], m) or min(shapes.segment_distance(r["x"], r["y"], e) for e in shapes.edges(m)) <= 60.0
                for m in polys)
        if n:
            want[r["place"]] = n
    assert got == want


@pytest.mark.parametrize("budget", [10**9, 3000, 1])
def test_roads_by_place_match_brute_force_in_crowded_cells(spark, budget, monkeypatch):
    monkeypatch.setattr(crowded.crowded_edge_rows, "__defaults__", (60, 0, None, True, None))
    rng = shapes.rng(13)
    lines = []
    for i in range(80):
        x, y = rng.gauss(0, 300), rng.gauss(0, 300)
        path = [shapes.pt(x, y)]
        for _ in range(rng.choice([0, 1, 3])):
            path.append(shapes.pt(path[-1]["x"] + rng.gauss(0, 200), path[-1]["y"] + rng.gauss(0, 200)))
        lines += [path] * rng.choice([1, 1, 2])
    roads = Layer(spark.createDataFrame([(i, 1.0, p) for i, p in enumerate(lines)],
                                        "rid bigint, FWIDTH double, path array<struct<x:double,y:double>>"),
                  "rid", "path", "line", 3857)
    where = nb.places(spots(spark, [(rng.gauss(0, 400), rng.gauss(0, 400)) for _ in range(200)]))
    got = {r["place"]: (r["count_roads"], r["count_roads_tied"], r["nearest_road_dist"])
           for r in nb.road_by_place(where, roads, 150.0, 250.0, budget).collect()}
    want = {}
    for r in where.collect():
        ds = []
        for path in lines:
            ends = list(zip(path, path[1:])) or [(path[0], path[0])]
            ds.append(min(shapes.segment_distance(r["x"], r["y"], (a["x"], a["y"], b["x"], b["y"])) for a, b in ends))
        ds = [d for d in ds if d <= 150.0]
        if ds:
            want[r["place"]] = (len(ds), sum(d == min(ds) for d in ds), pytest.approx(min(ds), abs=1e-9))
    assert got == want


def test_polygon_buffer_matches_its_corners(spark):
    """In reach means inside the polygon whose corners lie on the circle, the first one due east."""
    rng = shapes.rng(15)
    gon = [[shapes.ring([(10 * math.cos(2 * math.pi * i / 7), 10 * math.sin(2 * math.pi * i / 7)) for i in range(7)])]]
    points = [(rng.uniform(-11, 11), rng.uniform(-11, 11)) for _ in range(600)]
    objects = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "pid bigint, ox double, oy double")
    got = {r["pid"] for r in sj.points_within(spots(spark, [(0, 0)]), objects, 10.0, size=4.0, sides=7).collect()}
    assert got == {i for i, p in enumerate(points) if shapes.inside(*p, gon)}


def test_attach_deals_out_hot_and_null_keys(spark):
    rows = [(i, 1.0 if i < 400 else float(i)) for i in range(600)] + [(i, None) for i in range(600, 900)]
    left = spark.createDataFrame(rows, "id bigint, x double")
    right = spark.createDataFrame([(1.0, "a"), (450.0, "b")], "x double, v string")
    sizes = left.filter("x IS NOT NULL").groupBy("x").count().withColumnRenamed("count", "n")
    joined = skew.attach(left, right, ["x"], sizes, "id", min_rows=10)
    got = {r["id"]: (r["x"], r["v"]) for r in joined.collect()}
    assert got == {i: (x, {1.0: "a", 450.0: "b"}.get(x)) for i, x in rows}
    assert skew.hot_keys(sizes, ["x"], 10).count() == 1


def test_nearest_left_keeps_ties_and_unmatched(spark):
    lines = [[[shapes.pt(0, 10), shapes.pt(50, 10)]], [[shapes.pt(0, -10), shapes.pt(50, -10)]],
             [[shapes.pt(0, 20), shapes.pt(50, 20)]]]
    lay = Layer(spark.createDataFrame(list(enumerate(lines)), LINE), "id", "geom", "line", 3857)
    where = spots(spark, [(25, 0), (25, 9), (500, 500)])
    found = sj.nearest_left(where, ["qid"], cells.explode_edges(lay).withColumnRenamed("id", "rid"), "rid", 15.0, 10.0)
    got = sorted((r["qid"], r["rid"], r["dist"]) for r in found.filter("rid IS NOT NULL").collect())
    assert got == [(0, 0, 10.0), (0, 1, 10.0), (1, 0, 1.0)]
    assert [r["qid"] for r in found.filter("rid IS NULL").collect()] == [2]


def test_one_huge_area_does_not_fill_the_grid(spark):
    """Cell rows stay linear in the outlines when one area is a thousand times as wide as the others."""
    small = [[[shapes.ring([(x, y), (x + 0.03, y), (x + 0.03, y + 0.03), (x, y + 0.03)])]]
             for x in [i * 0.05 for i in range(50)] for y in [i * 0.05 for i in range(40)]]
    polys = small + [[[shapes.ring([(-10, -10), (10, -10), (10, 10), (-10, 10)])]]]
    lay = Layer(spark.createDataFrame(list(enumerate(polys)), POLYGON), "id", "geom", "polygon", 4326)
    assert sj.quadtree_pieces(areas.with_levels(lay)).count() < 200 * len(polys)
    where = spots(spark, [(0.01, 0.01), (1.0, 5.0), (50.0, 0.0), (0.04, 0.04)])
    got = sorted((r["qid"], r["id"]) for r in areas.areas_at(where, ["qid"], lay).collect())
    assert got == [(0, 0), (0, 2000), (1, 2000), (3, 2000)]
    found = areas.areas_at(where, ["qid"], lay)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "_level" in plan


@pytest.mark.parametrize("unit", [1e-4, 1.0, 7000.0])
def test_areas_of_very_different_sizes_in_one_join(spark, unit):
    rng = shapes.rng(31)
    polys = [shapes.polygon(rng, unit * 10 ** rng.uniform(0, 3.5)) for _ in range(40)] + [[[shapes.ring([(0, 0), (0, 0), (0, 0)])]], None]
    lay = Layer(spark.createDataFrame(list(enumerate(polys)), POLYGON), "id", "geom", "polygon", 3857)
    where = [(unit * 10 ** rng.uniform(-1, 3.6), unit * 10 ** rng.uniform(-1, 3.6)) for _ in range(150)]
    got = sorted((r["qid"], r["id"]) for r in areas.areas_at(spots(spark, where), ["qid"], lay).collect())
    want = [(q, i) for q, (x, y) in enumerate(where) for i, p in enumerate(polys) if p and shapes.inside(x, y, p)]
    assert got == want and len({i for _, i in want}) > 10
    levels = areas.with_levels(lay).df.select("_level").distinct().count()
    assert levels > 1
    assert areas.areas_at(spots(spark, where), ["qid"], lay.with_df(lay.df.limit(0))).count() == 0


def test_any_radius_is_searched_in_crowded_cells(spark):
    rng = shapes.rng(21)
    polys = [shapes.polygon(rng, 30.0) for _ in range(10)]
    lay = Layer(spark.createDataFrame(list(enumerate(polys)), POLYGON), "id", "geom", "polygon", 3857)
    where = nb.places(spots(spark, [(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(50)]))
    plain = {r["place"]: r["count_water"] for r in nb.water_counts(where, lay, 1.0, 50.0).collect()}
    assert plain == {r["place"]: r["count_water"] for r in nb.water_counts(where, lay, 1.0, 50.0, 0.5).collect()}
    with pytest.raises(ValueError, match="radius"):
        nb.water_counts(where, lay, 0.0)
