import json
import os

import pytest
from pyspark.errors import PySparkException

from hearthgrid import Layer
from hearthgrid.operators.columns import by_type
from hearthgrid.operators.profile import profile_layer
from hearthgrid.session import scratch_path, shared_folder
from hearthgrid.sources import geojson, sinks, tables
from tests import shapes


def feature(i, geometry, **properties):
    return {"type": "Feature", "properties": {"k": i, **properties}, "geometry": geometry}


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


POLYGONS = [
    feature(1, {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}, name="a,\"b\""),
    feature(2, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]],
                                                        [[[4, 0], [6, 0], [6, 2], [4, 2], [4, 0]]]]}, name=None),
    feature(3, None, name="none"),
]


@pytest.mark.parametrize("layout", ["lines", "collection", "one document"])
def test_polygons_are_read_from_every_layout(spark, tmp_path, layout):
    path = str(tmp_path / "layer.geojson")
    if layout == "lines":
        text = "\n".join(map(json.dumps, POLYGONS))
    elif layout == "collection":
        head = '{\n"type": "FeatureCollection",\n"name": "x",\n"features": [\n'
        text = head + ",\n".join("  " + json.dumps(f) for f in POLYGONS) + "\n]\n}\n"
    else:
        text = json.dumps({"type": "FeatureCollection", "features": POLYGONS}, indent=1)
    write(path, text)
    lay = geojson.read_geojson_layer(spark, path, "k", "polygon", collection=layout == "one document")
    assert lay.df.columns == ["k", "name", "geometry"]
    got = {r["k"]: (r["x"], r["y"]) for r in lay.located().collect()}
    assert got == {1: (1.0, 1.0), 2: (3.0, 1.0), 3: (None, None)}
    assert {r["k"]: r["name"] for r in lay.df.collect()}[1] == "a,\"b\""


def test_round_trip_keeps_properties_nulls_and_system(spark, tmp_path):
    rows = [(1, None, [[shapes.pt(0, 0), shapes.pt(111319.49079327358, 0)]]), (2, "b", None)]
    lay = Layer(spark.createDataFrame(rows, "k bigint, v string, g array<array<struct<x:double,y:double>>>"),
                "k", "g", "line", 3857)
    path = scratch_path(spark, "lines")
    geojson.write_geojson(lay, path)
    back = geojson.read_geojson_layer(spark, path, "k", "line")
    got = {r["k"]: r for r in back.df.collect()}
    assert got[1]["geometry"][0][1]["x"] == pytest.approx(1.0, abs=1e-12)
    assert got[1]["v"] is None and (got[2]["v"], got[2]["geometry"]) == ("b", None)


def test_poi_folder_takes_types_from_file_names(spark, tmp_path):
    for kind, spots in {"shop": [(1, 2), (3, 4)], "bus stop": [(5, 6)]}.items():
        rows = [feature(i, {"type": "Point", "coordinates": [*xy, 9.5]}) for i, xy in enumerate(spots)]
        write(str(tmp_path / f"{kind}.geojson"), "\n".join(map(json.dumps, rows)))
    lay = geojson.read_poi_folder(spark, str(tmp_path), "k")
    got = sorted((r["poi_type"], r["x"], r["y"]) for r in lay.located("poi_type").collect())
    assert [t for t, _, _ in got] == ["bus stop", "shop", "shop"]
    assert by_type(lay, "shop").df.count() == 2 and by_type(lay, "zoo").df.count() == 0
    moved = geojson.read_poi_folder(spark, str(tmp_path), "k", target=3857)
    assert moved.srid == 3857 and moved.located().first()["x"] > 100000


def test_layers_are_united_in_one_system_and_profiled(spark):
    schema = "k bigint, poi_type string, g struct<x:double,y:double>"
    a = Layer(spark.createDataFrame([(1, "shop", shapes.pt(1, 2))], schema), "k", "g", "point", 4326)
    b = Layer(spark.createDataFrame([(2, "zoo", shapes.pt(111319.49079327358, 0))], schema), "k", "g", "point", 3857)
    both = geojson.union_poi_layers(a, b)
    assert both.srid == 4326 and sorted(round(r["x"], 9) for r in both.located().collect()) == [1.0, 1.0]
    rows = {r["column"]: r for r in profile_layer(both).collect()}
    assert rows["k"]["n_rows"] == 2 and rows["g"]["srid"] == 4326


def test_empty_folders_missing_files_and_broken_features_fail(spark, tmp_path):
    with pytest.raises(PySparkException):
        geojson.read_poi_folder(spark, str(tmp_path))
    with pytest.raises(PySparkException):
        tables.read_table(spark, str(tmp_path / "no.parquet"))
    write(str(tmp_path / "bad.geojson"), '{"type": "Feature", "properties": {"k": 1}, "geometry": {{}\n')
    from pyspark.sql.types import LongType, StructField, StructType
    props = StructType([StructField("k", LongType())])
    with pytest.raises(Exception, match="MALFORMED"):
        geojson.read_poi_folder(spark, str(tmp_path), "k", props).df.collect()
    whole = str(tmp_path / "whole.geojson")
    write(whole, json.dumps({"type": "FeatureCollection", "features": POLYGONS}, indent=1))
    with pytest.raises(Exception, match="not one feature per line"):
        geojson.read_geojson(spark, whole, "polygon", props).collect()


def test_layers_name_their_missing_columns(spark, tmp_path):
    path = str(tmp_path / "areas.parquet")
    spark.createDataFrame([(1, "a")], "OBJECTID bigint, FNAME string").write.parquet(path)
    with pytest.raises(ValueError, match="Eng_Name"):
        tables.read_layer(spark, path, "OBJECTID", "FNAME", "polygon", 4326, required=["FNAME", "Eng_Name"])


def test_catalog_finds_files_in_subfolders(spark, tmp_path):
    for name in ("a/x.shp", "a/b/y.shp", "a/z.dbf"):
        write(str(tmp_path / name), "12345")
    rows = tables.file_catalog(spark, str(tmp_path), ".shp").collect()
    assert sorted((r["folder"], r["stem"], r["length"]) for r in rows) == [("a", "x", 5), ("b", "y", 5)]


def test_predictions_are_written_per_model_with_errors(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1, 2.0, 3.0), ("m2", 1, 2.0, 1.5)], "model string, id bigint, y_true double, y_pred double")
    share = spark.createDataFrame([("m1", "f", 1.0)], "model string, feature string, importance double")
    sinks.write_predictions(df, str(tmp_path / "out"), share)
    back = spark.read.parquet(str(tmp_path / "out" / "predictions"))
    assert {r["model"]: r["error"] for r in back.collect()} == {"m1": 1.0, "m2": -0.5}
    assert spark.read.parquet(str(tmp_path / "out" / "importances")).count() == 1
    sinks.write_predictions(df, str(tmp_path / "text"), text=True)
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "text" / "predictions" / "model=m1"))


def test_scratch_follows_the_session_setting(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert scratch_path(spark, "x").startswith(folder) and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_one_line_collections_are_read(spark, tmp_path):
    rows = [feature(i, {"type": "Point", "coordinates": [i, 2.0]}) for i in range(5)]
    path = str(tmp_path / "one.geojson")
    write(path, json.dumps({"type": "FeatureCollection", "features": rows}))
    got = geojson.read_geojson_layer(spark, path, "k", "point").located().collect()
    assert sorted((r["k"], r["x"]) for r in got) == [(i, float(i)) for i in range(5)]
    assert geojson.read_poi_folder(spark, str(tmp_path), "k").df.filter("geometry IS NOT NULL").count() == 5


@pytest.mark.parametrize("name,good", [("urn:ogc:def:crs:EPSG::3857", False), ("EPSG:4326", True), ("urn:ogc:def:crs:OGC:1.3:CRS84", True)])
@pytest.mark.parametrize("layout", ["lines", "one line", "document"])
def test_a_file_in_another_system_is_refused(spark, tmp_path, name, good, layout):
    crs = {"type": "name", "properties": {"name": name}}
    rows = [feature(1, {"type": "Point", "coordinates": [1.0, 2.0]})]
    whole = {"type": "FeatureCollection", "crs": crs, "features": rows}
    text = {"one line": json.dumps(whole), "document": json.dumps(whole, indent=1),
            "lines": '{\n"type": "FeatureCollection",\n"crs": %s,\n"features": [\n%s\n]\n}' % (json.dumps(crs), json.dumps(rows[0]))}
    path = str(tmp_path / "a.geojson")
    write(path, text[layout])
    read = geojson.read_geojson(spark, path, "point", collection=layout == "document")
    if good:
        assert read.count() == 1 and read.first()["geometry"]["x"] == 1.0
    else:
        with pytest.raises(Exception, match="another reference system"):
            read.collect()


@pytest.mark.parametrize("kind,geometry", [("point", {"type": "MultiPoint", "coordinates": [[1, 2]]}),
                                           ("point", POLYGONS[0]["geometry"]), ("line", {"type": "Point", "coordinates": [1, 2]})])
def test_geometry_of_another_type_is_refused(spark, tmp_path, kind, geometry):
    write(str(tmp_path / "a.geojson"), json.dumps(feature(1, geometry)))
    with pytest.raises(Exception, match="cannot hold geometry"):
        geojson.read_geojson(spark, str(tmp_path / "a.geojson"), kind).collect()


def test_poi_folders_hold_shapes_and_odd_names(spark, tmp_path):
    for name in ("100%+", "v1.2", "Shop", "shop"):
        write(str(tmp_path / f"{name}.geojson"), json.dumps({"type": "FeatureCollection", "features": POLYGONS}, indent=1))
    lay = geojson.read_poi_folder(spark, str(tmp_path), "k", kind="polygon", collection=True)
    assert {r[0] for r in lay.df.select("poi_type").distinct().collect()} == {"100%+", "v1.2", "Shop", "shop"}
    whole = sum(f["geometry"] is not None for f in POLYGONS)
    assert lay.kind == "polygon" and lay.df.filter("geometry IS NOT NULL").count() == 4 * whole > 0


@pytest.mark.parametrize("size", ["64", "500", "100000"])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, size):
    odd = {"a": '}{ "quoted\\" [', "b": {"c": [{"d": "}"}]}, "e": "\\"}
    shapes_ = [{"type": "Point", "coordinates": [i, -i]} for i in range(60)]
    rows = [{"type": "Feature", "properties": {"k": i, **(odd if i % 3 == 0 else {})}, "geometry": s} for i, s in enumerate(shapes_)]
    whole = {"type": "FeatureCollection", "name": "x } y", "notes": {"f": [{"type": "Feature", "g": [1, {}]}] * 5},
             "features": rows, "more": [{"type": "Other"}], "tail": "{[\""}
    write(str(tmp_path / "a.geojson"), json.dumps(whole))
    write(str(tmp_path / "b.geojson"), json.dumps({"type": "FeatureCollection", "features": rows[:7]}, indent=2))
    write(str(tmp_path / "c.geojson"), json.dumps({"type": "FeatureCollection", "features": []}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = f"{tmp_path}/*.geojson"
        parts = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        got = geojson.read_geojson_layer(spark, path, "k", "point", collection="ranges").df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > (10 if size != "100000" else 0)
    assert sorted((r["k"], r["geometry"]["x"], r["geometry"]["y"]) for r in got) == sorted(
        [(i, float(i), float(-i)) for i in range(60)] + [(i, float(i), float(-i)) for i in range(7)])
    assert {r["a"] for r in got} == {odd["a"], None} and {r["e"] for r in got} == {"\\", None}


def test_documents_in_ranges_name_their_system(spark, tmp_path):
    crs = {"type": "name", "properties": {"name": "EPSG:3857"}}
    rows = [feature(1, {"type": "Point", "coordinates": [1.0, 2.0]})]
    write(str(tmp_path / "a.geojson"), json.dumps({"type": "FeatureCollection", "crs": crs, "features": rows}))
    with pytest.raises(Exception, match="another reference system"):
        geojson.read_geojson(spark, str(tmp_path / "a.geojson"), "point", collection="ranges").collect()
    got = geojson.read_geojson(spark, str(tmp_path / "a.geojson"), "point", collection="ranges", srid=3857).collect()
    assert got[0]["geometry"]["x"] == 1.0


def test_ranges_of_a_document_grow_with_it(spark, tmp_path):
    from checks.catalog import document_range_bytes
    write(str(tmp_path / "small.txt"), "x" * 1000)
    write(str(tmp_path / "large.txt"), "x" * (64 << 20))
    assert document_range_bytes(spark, str(tmp_path / "small.txt")) == 32 << 10
    assert document_range_bytes(spark, str(tmp_path / "large.txt")) == (64 << 20) // 256
