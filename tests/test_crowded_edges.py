"""The crowded search for roads and outlines: what comes out of it grows with the places, not with the pairs."""

import pytest

from hearthgrid.layer import Layer
from hearthgrid.operators import neighbours as nb
from hearthgrid.operators.cells import explode_edges
from hearthgrid.operators.crowded import crowded_edge_rows
from tests import shapes

ROADS = "rid bigint, FWIDTH double, path array<struct<x:double,y:double>>"


@pytest.fixture(scope="module")
def town(spark):
    """300 places among 400 roads of up to three pieces, some drawn twice; every place has about 150 in range."""
    rng = shapes.rng(31)
    lines = []
    for _ in range(200):
        path = [shapes.pt(rng.gauss(0, 120), rng.gauss(0, 120))]
        for _ in range(rng.choice([0, 1, 3])):
            path.append(shapes.pt(path[-1]["x"] + rng.gauss(0, 60), path[-1]["y"] + rng.gauss(0, 60)))
        lines += [path] * 2
    roads = Layer(spark.createDataFrame([(i, 1.0, p) for i, p in enumerate(lines)], ROADS), "rid", "path", "line", 3857)
    rows = [(rng.gauss(0, 150), rng.gauss(0, 150)) for _ in range(300)]
    where = nb.places(spark.createDataFrame(rows, "x double, y double"))
    return lines, roads, where


def distances(lines, r):
    return [min(shapes.segment_distance(r["x"], r["y"], (a["x"], a["y"], b["x"], b["y"]))
                for a, b in list(zip(p, p[1:])) or [(p[0], p[0])]) for p in lines]


def test_pairs_of_crowded_cells_are_not_rows(town):
    lines, roads, where = town
    exact, settled = crowded_edge_rows(where.select("place", "x", "y"), explode_edges(roads.projected()), "rid", 150.0, 250.0)
    found = exact.collect()
    pairs = sum(sum(d <= 150.0 for d in distances(lines, r)) for r in where.collect())
    assert len(found) <= where.count() < pairs / 20
    assert sum(r["n"] for r in found) + sum(r["n"] for r in settled.collect()) == pairs


@pytest.mark.parametrize("small", [200, 1 << 24])
def test_roads_in_blocks_match_brute_force(town, small, monkeypatch):
    monkeypatch.setattr(crowded_edge_rows, "__defaults__", (small, 0, None, True, None))
    lines, roads, where = town
    got = {r["place"]: (r["count_roads"], r["count_roads_tied"], r["nearest_road_dist"])
           for r in nb.road_by_place(where, roads, 150.0, 250.0, 1).collect()}
    want = {}
    for r in where.collect():
        near = [d for d in distances(lines, r) if d <= 150.0]
        if near:
            want[r["place"]] = (len(near), sum(d == min(near) for d in near), pytest.approx(min(near), abs=1e-9))
    assert got == want
