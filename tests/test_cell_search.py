"""The searches of one cell against brute force, and how they are dealt out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearthgrid.layer import Layer
from hearthgrid.operators import cell_search as cs
from hearthgrid.operators import cells
from hearthgrid.operators import crowded
from hearthgrid.operators import spatial_join as sj


def _rows(n, seed):
    draw = random.Random(seed)
    return [(i, draw.uniform(0, 30), draw.uniform(0, 30)) for i in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    places = spark.createDataFrame(_rows(120, 1), "place long, x double, y double")
    objects = spark.createDataFrame([(i % 3 + 1, f"k{i % 2}", x, y) for i, x, y in _rows(200, 2)],
                                    "copies long, kind string, ox double, oy double")
    return places, objects


def _counted(rows):
    return {(r["place"], r["kind"]): (r["n"], round(r["dist"], 9)) for r in rows.groupBy("place", "kind")
            .agg(F.sum("n").alias("n"), F.min("dist").alias("dist")).collect()}


def _brute(places, objects, radius):
    out, objects = {}, objects.collect()
    for p in places.collect():
        for o in objects:
            d = math.hypot(p["x"] - o["ox"], p["y"] - o["oy"])
            if d < radius:
                n, best = out.get((p["place"], o["kind"]), (0, d))
                out[p["place"], o["kind"]] = n + o["copies"], min(best, d)
    return {k: (n, round(d, 9)) for k, (n, d) in out.items()}


def _search(made, **options):
    places, objects = made
    return cs.search_cells(cells.with_cell(places, "x", "y", 10.0), cells.spread_points(objects, "ox", "oy", 6.0, 10.0),
                           ["ox", "oy"], cs.points_of_cell(6.0), cs.POINT_ROWS, **options)


def test_points_of_a_cell_equal_brute_force(made):
    assert _counted(_search(made)) == _brute(*made, 6.0)


def test_cells_with_much_work_are_dealt_out_and_lose_nothing(made, monkeypatch):
    """Parts of the places and slices of the objects; few bytes with many pairs become many tasks."""
    monkeypatch.setattr(cs, "MOST_PIECES", 20)
    monkeypatch.setattr(cs, "TASK_TESTS", 1000)
    found = _search(made, budget=300)
    assert found.rdd.getNumPartitions() > 5
    assert _counted(found) == _brute(*made, 6.0)


def test_crowded_search_broadcasts_nothing(made):
    rows = crowded.crowded_rows(made[0], made[1], 6.0, 10.0)
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().toString()
    assert _counted(rows) == _brute(*made, 6.0)


@pytest.mark.parametrize("small", [40, crowded.BLOCKED])
def test_leaves_of_the_crowded_search_give_a_row_per_place_and_kind(made, small):
    """On each level, however many pairs there are."""
    rows = crowded.crowded_rows(made[0], made[1], 6.0, 10.0, small)
    assert _counted(rows) == _brute(*made, 6.0)
    assert max(r["count"] for r in rows.filter("dist IS NOT NULL").groupBy("place", "kind").count().collect()) <= (1 if small > 40 else 4)


def test_a_point_that_comes_twice_meets_a_polygon_once(spark):
    box = spark.sql("SELECT 1L AS id, array(array(struct(0D AS x, 0D AS y), struct(4D AS x, 0D AS y), struct(4D AS x, 4D AS y), "
                    "struct(0D AS x, 4D AS y), struct(0D AS x, 0D AS y))) AS shape")
    spots = spark.createDataFrame([(7, 2.0, 2.0), (7, 2.0, 2.0), (8, 4.5, 2.0), (9, 9.0, 9.0)], "qid long, x double, y double")
    found = sj.polygons_at(spots, ["qid"], Layer(box, "id", "shape", "polygon", 3857), 1.0, 10.0)
    assert sorted(map(tuple, found.collect())) == [(7, 1, True, 0.0), (8, 1, False, 0.5)]
