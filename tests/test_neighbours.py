import math

import pytest

from hearthgrid import Layer
from hearthgrid.operators import neighbours as nb
from hearthgrid.operators.areas import area_features, points_in_areas
from hearthgrid.operators.raster import Raster, pixels_of, sample, sample_places, to_tiles
from hearthgrid.sources.tables import read_tiles, write_tiles
from hearthgrid.plans.building_features import building_features
from tests import shapes

POINT = "struct<x:double,y:double>"
RINGS = "array<array<struct<x:double,y:double>>>"
PATH = "array<struct<x:double,y:double>>"
INF = float("inf")


def layer(spark, rows, columns, key, geom, kind, srid=3857):
    return Layer(spark.createDataFrame(rows, columns), key, geom, kind, srid)


def box(x0, y0, x1, y1):
    return [shapes.ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


def buildings(spark):
    """Two copies at one place, one far away, one without geometry."""
    rows = [(1, box(-5, -5, 5, 5)), (2, box(-5, -5, 5, 5)), (3, box(90000, 0, 90010, 10)), (4, None)]
    return layer(spark, rows, f"building_id bigint, shape {RINGS}", "building_id", "shape", "polygon")


def by_id(df):
    return {r["building_id"]: r for r in df.collect()}


def test_poi_counts_copies_and_leaves_null_distance_when_none(spark):
    pois = layer(spark, [(1, "shop", shapes.pt(30, 40)), (2, "shop", shapes.pt(30, 40)),
                         (3, "school", shapes.pt(0, 499)), (4, "school", shapes.pt(0, 500)),
                         (5, "shop", None)],
                 f"poi_id bigint, poi_type string, spot {POINT}", "poi_id", "spot", "point")
    got = by_id(nb.poi_features(buildings(spark), pois, 500.0))
    for i in (1, 2):
        assert (got[i]["count_shop"], got[i]["nearest_shop_dist"]) == (2, 50.0)
        assert (got[i]["count_school"], got[i]["nearest_school_dist"]) == (1, 499.0)
    for i in (3, 4):
        assert (got[i]["count_shop"], got[i]["nearest_shop_dist"]) == (0, None)


def test_poi_radius_defaults_to_a_kilometre_and_types_may_be_given(spark):
    pois = layer(spark, [(1, "shop", shapes.pt(0, 900))],
                 f"poi_id bigint, poi_type string, spot {POINT}", "poi_id", "spot", "point")
    got = by_id(nb.poi_features(buildings(spark), pois, types=["shop", "zoo"]))
    assert got[1]["count_shop"] == 1 and got[1]["count_zoo"] == 0


def test_poi_shapes_count_only_if_wholly_in_range(spark):
    rows = [(1, "park", box(-50, -50, 50, 50)), (2, "park", box(300, 0, 400, 10)), (3, "park", box(450, 0, 600, 10))]
    parks = layer(spark, rows, f"poi_id bigint, poi_type string, shape {RINGS}", "poi_id", "shape", "polygon")
    got = by_id(nb.poi_features(buildings(spark), parks, 500.0))
    assert (got[1]["count_park"], got[1]["nearest_park_dist"]) == (2, 0.0)
    assert (got[3]["count_park"], got[3]["nearest_park_dist"]) == (0, None)
    lines = [(1, "tram", [shapes.pt(30, 40), shapes.pt(300, 400), shapes.pt(30, 40)]), (2, "tram", [shapes.pt(0, 9), shapes.pt(0, 501)])]
    trams = layer(spark, lines, f"poi_id bigint, poi_type string, path {PATH}", "poi_id", "path", "line")
    got = by_id(nb.poi_features(buildings(spark), trams, 501.0))
    assert (got[2]["count_tram"], got[2]["nearest_tram_dist"]) == (1, 50.0)


def test_water_counts_shapes_but_measures_to_centres(spark):
    wide = box(400, -1000, 3000, 1000)
    small = box(-10, 590, 10, 608)
    around = box(-50, -50, 50, 50)
    water = layer(spark, [(1, wide), (2, small), (3, around)], f"water_id bigint, shape {RINGS}",
                  "water_id", "shape", "polygon")
    got = by_id(nb.water_features(buildings(spark), water))
    # The wide one is in reach, the small one is not; its centre at 599 m is what is measured
    # if the surrounding one is left out.
    assert (got[1]["count_water"], got[1]["nearest_water_dist"]) == (2, 0.0)
    assert (got[3]["count_water"], got[3]["nearest_water_dist"]) == (0, INF)
    without = water.with_df(water.df.filter("water_id < 3"))
    got = by_id(nb.water_features(buildings(spark), without))
    assert (got[2]["count_water"], got[2]["nearest_water_dist"]) == (1, 599.0)


def test_roads_report_ties_and_range_separately(spark):
    def road(i, w, y):
        return (i, w, [shapes.pt(-100, y), shapes.pt(100, y)])
    rows = [road(1, 3.0, 20), road(2, 3.0, -20), road(3, 2.0, 100), road(4, 0.0, 1), road(5, None, 1),
            road(6, float("nan"), 1), road(7, 1.0, 500), road(8, 1.0, 501)]
    roads = layer(spark, rows, f"road_id bigint, FWIDTH double, path {PATH}", "road_id", "path", "line")
    got = by_id(nb.road_features(buildings(spark), roads))
    assert (got[1]["count_roads"], got[1]["count_roads_tied"], got[1]["nearest_road_dist"]) == (4, 2, 20.0)
    assert (got[3]["count_roads"], got[3]["count_roads_tied"], got[3]["nearest_road_dist"]) == (0, 1, INF)
    with pytest.raises(ValueError, match="FWIDTH"):
        nb.usable_roads(roads.with_df(roads.df.drop("FWIDTH")))


def test_empty_layers_give_defaults(spark):
    pois = layer(spark, [], f"poi_id bigint, poi_type string, spot {POINT}", "poi_id", "spot", "point")
    water = layer(spark, [], f"water_id bigint, shape {RINGS}", "water_id", "shape", "polygon")
    roads = layer(spark, [], f"road_id bigint, FWIDTH double, path {PATH}", "road_id", "path", "line")
    pixels = spark.createDataFrame([], "row_idx bigint, col_idx bigint, value double")
    out = building_features(buildings(spark), Raster(pixels, 0.0, 1.0, 0.1, 0.1), pois, water, roads)
    for r in out.collect():
        assert (r["population"], r["count_water"], r["nearest_water_dist"]) == (0.0, 0, INF)
        assert (r["count_roads"], r["count_roads_tied"], r["nearest_road_dist"]) == (0, 1, INF)
    assert out.count() == 4


def test_raster_nodata_nan_and_outside_become_zero(spark):
    points = [(1, shapes.pt(0.5, 9.5)), (2, shapes.pt(1.5, 9.5)), (3, shapes.pt(2.5, 9.5)),
              (4, shapes.pt(0.5, 8.5)), (5, shapes.pt(50, 50)), (6, None)]
    spots = layer(spark, points, f"building_id bigint, spot {POINT}", "building_id", "spot", "point", 4326)
    pixels = spark.createDataFrame([(0, 0, 7.5), (0, 1, -1.0), (0, 2, float("nan"))],
                                   "row_idx bigint, col_idx bigint, value double")
    got = {r["building_id"]: r["population"]
           for r in sample(spots, Raster(pixels, 0.0, 10.0, 1.0, 1.0, -1.0)).collect()}
    assert got == {1: 7.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}


def test_areas_keep_overlaps_and_unmatched(spark):
    areas = layer(spark, [(7, "A", "a", box(0, 0, 2, 2)), (8, "B", "b", box(1, 1, 3, 3))],
                  f"OBJECTID bigint, FNAME string, Eng_Name string, shape {RINGS}", "OBJECTID", "shape", "polygon", 4326)
    points = layer(spark, [(1, shapes.pt(0.5, 0.5)), (2, shapes.pt(1.5, 1.5)), (3, shapes.pt(9, 9)),
                           (4, shapes.pt(0, 1)), (5, None)],
                   f"building_id bigint, spot {POINT}", "building_id", "spot", "point", 4326)
    got = sorted((r["building_id"], r["area_OBJECTID"] or 0, r["area_FNAME"] or "") for r in area_features(points, areas).collect())
    assert got == [(1, 7, "A"), (2, 7, "A"), (2, 8, "B"), (3, 0, ""), (4, 0, ""), (5, 0, "")]
    assert sorted(r[0] for r in points_in_areas(points, areas).select("building_id").collect()) == [1, 2, 2]
    # Points in metres meet areas in degrees after the areas are moved.
    assert points_in_areas(points.projected(), areas).count() == 3
    with pytest.raises(ValueError, match="missing"):
        area_features(points, areas.with_df(areas.df.drop("FNAME")))


def test_area_of_a_footprint_is_taken_at_its_utm_centre(spark):
    areas = layer(spark, [(7, "A", "a", box(119.6, 30.2, 119.7, 30.3))],
                  f"OBJECTID bigint, FNAME string, Eng_Name string, shape {RINGS}", "OBJECTID", "shape", "polygon", 4326)
    homes = layer(spark, [(1, box(119.65, 30.25, 119.651, 30.251)), (2, box(119.699, 30.25, 119.703, 30.251))],
                  f"building_id bigint, shape {RINGS}", "building_id", "shape", "polygon", 4326)
    got = {r["building_id"]: r["area_OBJECTID"] for r in area_features(homes, areas).collect()}
    assert got == {1: 7, 2: None}


def test_job_with_areas_keeps_one_row_per_building(spark):
    pois = layer(spark, [(1, "shop", shapes.pt(30, 40))], f"poi_id bigint, poi_type string, spot {POINT}", "poi_id", "spot", "point")
    water = layer(spark, [(1, box(-50, -50, 50, 50))], f"water_id bigint, shape {RINGS}", "water_id", "shape", "polygon")
    roads = layer(spark, [(1, 2.0, [shapes.pt(-9, 9), shapes.pt(9, 9)])], f"road_id bigint, FWIDTH double, path {PATH}", "road_id", "path", "line")
    areas = layer(spark, [(8, "B", "b", box(-99, -99, 99, 99)), (7, "A", "a", box(-999, -999, 999, 999))],
                  f"OBJECTID bigint, FNAME string, Eng_Name string, shape {RINGS}", "OBJECTID", "shape", "polygon")
    pixels = spark.createDataFrame([(0, 0, 4.0)], "row_idx bigint, col_idx bigint, value double")
    homes = buildings(spark)
    homes = homes.with_df(homes.df.selectExpr("*", "1.0 AS LandArea"))
    out = by_id(building_features(homes, Raster(pixels, -0.5, 0.5, 1.0, 1.0), pois, water, roads, areas))
    assert len(out) == 4 and "LandArea" not in out[1].asDict()
    assert (out[1]["area_OBJECTID"], out[1]["area_FNAME"], out[1]["population"]) == (7, "A", 4.0)
    assert math.isinf(out[3]["nearest_road_dist"]) and out[3]["area_FNAME"] is None


@pytest.mark.parametrize("side", [1, 3, 64])
def test_tiles_hold_the_pixels_and_sample_the_same(spark, side):
    rng = shapes.rng(12)
    rows = [(rng.randrange(-5, 40), rng.randrange(0, 50), rng.choice([None, float("nan"), -1.0, rng.random()])) for _ in range(700)]
    pixels = spark.createDataFrame(rows, "row_idx bigint, col_idx bigint, value double").repartition(3)
    raster = Raster(pixels, 0.0, 10.0, 0.1, 0.1, -1.0)
    tiles = to_tiles(raster, side)
    want = {}
    for r, col, v in rows:
        if v is not None and v == v and v != -1.0:
            want[r, col] = max(v, want.get((r, col), v))
    assert {(p["row_idx"], p["col_idx"]): p["value"] for p in pixels_of(tiles).collect()} == want
    places = [(i, shapes.pt(rng.uniform(-1, 6), rng.uniform(5, 11))) for i in range(300)] + [(300, None)]
    spots = Layer(spark.createDataFrame(places, f"building_id bigint, spot {POINT}"), "building_id", "spot", "point", 4326)
    plain = {r["building_id"]: r["population"] for r in sample(spots, raster).collect()}
    assert plain == {r["building_id"]: r["population"] for r in sample(spots, tiles).collect()} and any(plain.values())
    for i, spot in places[:-1]:
        assert plain[i] == pytest.approx(want.get((math.floor((10.0 - spot["y"]) / 0.1), math.floor(spot["x"] / 0.1)), 0.0))


def test_the_extent_of_the_places_reaches_the_scan_of_tiles(spark, tmp_path):
    pixels = spark.range(10_000).selectExpr("id DIV 100 AS row_idx", "id % 100 AS col_idx", "CAST(id AS DOUBLE) AS value")
    blocks = to_tiles(Raster(pixels, 0.0, 10.0, 0.1, 0.1), 8)
    write_tiles(blocks, str(tmp_path / "tiles"))
    tiles = read_tiles(spark, str(tmp_path / "tiles"), 8, 0.0, 10.0, 0.1, 0.1)
    spots = spark.createDataFrame([(1, 1.0e5, 1.1e6)], "place bigint, x double, y double")
    out = sample_places(spots, tiles)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "tile_row" in plan.split("DataFilters")[1].split("]")[0] and "tile_col" in plan.split("DataFilters")[1].split("Format")[0]
    assert out.count() == 1
    assert sample_places(spots.limit(0), tiles).count() == 0
