"""The jobs from files to files, and the shape of their plans."""

import json

import pytest

from checks import fixtures as fx
from checks.catalog import QUERIES
from hearthgrid.operators.raster import Raster
from hearthgrid.plans import jobs
from hearthgrid.session import scratch_path
from hearthgrid.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_features_are_written_as_parquet_and_geojson(spark):
    layers = [fx.pois(spark, SF), fx.water(spark, SF), fx.roads(spark, SF)]
    raster = Raster(fx.view(spark, SF, "fx_pixels"), **fx.RASTER)
    table, text = scratch_path(spark, "features"), scratch_path(spark, "features")
    jobs.build_features(fx.buildings(spark, SF), raster, *layers, table)
    jobs.build_features(fx.buildings(spark, SF), raster, *layers, text, as_geojson=True)
    assert read_table(spark, table).count() == spark.read.text(text).count() == 150
    row = json.loads(spark.read.text(text).first()[0])
    assert row["type"] == "Feature" and "count_urgent" in row["properties"]


def test_cleaning_and_training_run_from_file_to_file(spark, tmp_path):
    source = str(tmp_path / "homes.geojson")
    with open(source, "w") as f:
        for i in range(400):
            ring = [[i, 0], [i + 1, 0], [i + 1, 1], [i, 0]]
            f.write(json.dumps({"type": "Feature", "properties": {
                "id": i, "peopleCount": 5 * (i % 40) + i % 3, "floors": str(i % 40), "kind": f"k{i % 3}",
                "GlobalID": f"g{i}", "area": i * 0.5 if i % 9 else None},
                "geometry": {"type": "Polygon", "coordinates": [ring]}}) + "\n")
    table, text = str(tmp_path / "clean.parquet"), str(tmp_path / "clean.geojson")
    jobs.clean_file(spark, source, table, text)
    clean = read_table(spark, table)
    kinds = {f.name: f.dataType.simpleString() for f in clean.schema if f.name != "geometry"}
    assert set(kinds) == {"id", "peopleCount", "floors", "kind", "area"} and "string" not in kinds.values()
    assert spark.read.text(text).count() == 400
    results = str(tmp_path / "results")
    jobs.train_file(spark, table, str(tmp_path / "models"), results, names=["linear_regression", "random_forest"], search=False)
    board = {(r["model"], r["scope"]): r for r in read_table(spark, f"{results}/leaderboard").collect()}
    assert board["linear_regression", "test"]["r2"] > 0.99 and len(board) == 6
    assert read_table(spark, f"{results}/predictions").count() == 800
    assert read_table(spark, f"{results}/importances").count() == 3
    assert read_table(spark, f"{results}/density").groupBy("model").sum("n").collect()[0][1] == 400
    assert read_table(spark, f"{results}/target").first()["max"] == 197


@pytest.mark.parametrize("name", ["building_features", "poi_within_radius", "water_within_radius", "road_nearest_left",
                                  "building_area_left", "population_sample", "clean_attributes", "hex_density"])
def test_plans_join_on_equal_keys_only(spark, name):
    """Also where nothing is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for bad in ("CartesianProduct", "NestedLoop", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert bad not in plan, bad
    assert "Join" in plan


def test_scans_read_only_what_they_need(spark):
    some = QUERIES["scan_feature_table"](spark, SF).select("o_orderkey", "o_custkey", "o_totalprice")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    plan = QUERIES["population_sample_pixels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "o_orderkey,1500" not in plan


def test_nearest_joins_cut_down_before_the_shuffle(spark):
    plan = QUERIES["road_nearest_left"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "WindowGroupLimit" in line or "Exchange hashpartitioning(building_id" in line]
    first = next(i for i, line in enumerate(lines) if "Partial" in line)
    assert any("Exchange" in line for line in lines[:first]) and any("Final" in line for line in lines[:first])


def test_searches_share_the_shuffled_places(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["building_features"](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("ReusedExchange") >= 2
