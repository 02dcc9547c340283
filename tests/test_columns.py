import hashlib
import math

import numpy as np
import pytest

from hearthgrid.config import LEAK_COLUMNS
from hearthgrid.operators import columns as c
from hearthgrid.operators import metrics as m
from hearthgrid.operators import prep
from hearthgrid.operators import profile as pf
from hearthgrid.plans.clean_attributes import clean_attributes, target_report


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, v {kind}")


@pytest.mark.parametrize("values, kind, want", [
    (["1", " 2 ", "-3"], "bigint", [1, 2, -3]),
    (["1", None], "double", [1.0, None]),
    (["1", ""], "double", [1.0, None]),
    (["1.0", "2"], "double", [1.0, 2.0]),
    (["1e3", ".5", "5.", "+7"], "double", [1000.0, 0.5, 5.0, 7.0]),
    (["inf", "-Infinity", "1"], "double", [math.inf, -math.inf, 1.0]),
    ([None, None], "double", [None, None]),
    (["99999999999999999999", "1"], "double", [1e20, 1.0]),
    (["1", "1d"], "label", ["1", "1d"]),
    (["1", "nan"], "label", ["1", "nan"]),
    (["1,5", "0x10", "1_000", "True"], "label", ["1,5", "0x10", "1_000", "True"]),
])
def test_text_columns_become_numbers_only_if_every_value_parses(spark, values, kind, want):
    df = column(spark, values)
    kinds = c.column_kinds(df)
    assert kinds == {"v": kind}
    assert [r["v"] for r in c.to_numeric(df, kinds).orderBy("id").collect()] == want


def test_geometry_is_not_touched_and_booleans_become_numbers(spark):
    df = spark.createDataFrame([("1", "5", True), ("2", "6", None)], "geometry string, t string, b boolean")
    out = clean_attributes(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "bigint", "double"]


def test_labels_are_dense_sorted_and_null_is_missing(spark):
    values = ["b", None, "a", "MISSING", "b", "Z", "é", "\U0001F600", "～"]
    df = column(spark, values)
    codes = {r["label"]: r["code"] for r in c.label_dictionary(df, ["v"]).collect()}
    order = sorted({v or "MISSING" for v in values}, key=lambda s: s.encode("utf-8"))
    assert codes == {v: i for i, v in enumerate(order)}
    got = {r["id"]: r["v"] for r in c.encode_labels(df, ["v"], c.label_dictionary(df, ["v"])).collect()}
    assert got == {i: codes[v or "MISSING"] for i, v in enumerate(values)}


def test_many_labels_are_numbered_across_partitions(spark):
    df = spark.range(5000).selectExpr("concat('k', id * 7919 % 5000) AS a", "CAST(id % 3 AS STRING) AS b")
    codes = c.label_dictionary(df, ["a", "b"])
    want = {("a", v): i for i, v in enumerate(sorted(f"k{i}" for i in range(5000)))}
    want |= {("b", str(i)): i for i in range(3)}
    assert {(r["column"], r["label"]): r["code"] for r in codes.collect()} == want


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantile_is_exact_and_skips_what_is_not_measured(spark, q):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.round(rng.gamma(1.0, 30.0, 777), 1)]
    df = column(spark, values + [None, float("nan")] * 5, "double")
    got = c.exact_quantile(df, "v", q).first()[0]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-12)
    kept = c.at_most_quantile(df, "v", q)
    assert sorted(r["v"] for r in kept.collect()) == sorted(v for v in values if v <= got)


def test_quantile_of_nothing_is_null(spark):
    df = column(spark, [None, float("nan")], "double")
    assert c.exact_quantile(df, "v").first()[0] is None
    assert c.at_most_quantile(df, "v").count() == 0


def test_cleaning_keeps_the_filter_off_unless_asked(spark):
    df = spark.createDataFrame([(i, f"x{i % 3}", str(i)) for i in range(200)], "peopleCount bigint, t string, GlobalID string")
    assert clean_attributes(df).count() == 200
    assert clean_attributes(df).columns == ["peopleCount", "t"]
    assert clean_attributes(df, quantile=0.99).count() == 198
    assert target_report(df).first().asDict() == {"n_rows": 200, "quantile": pytest.approx(197.01), "n_kept": 198}


def test_leak_columns_are_the_identifier_and_the_counts():
    assert len(LEAK_COLUMNS) == 33 and len(set(LEAK_COLUMNS)) == 33
    assert "count_w_more_70" in LEAK_COLUMNS and "count_m_all" in LEAK_COLUMNS


def test_non_finite_values_become_zero(spark):
    df = column(spark, [1.5, None, float("nan"), math.inf, -math.inf, -2.0], "double")
    assert [r["v"] for r in c.clean_non_finite(df, ["v"]).orderBy("id").collect()] == [1.5, 0, 0, 0, 0, -2.0]


def test_strict_drop_lookup_fill_and_union(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    with pytest.raises(ValueError, match="missing required columns: \\['nope'\\]"):
        c.drop_required(df, ["v", "nope"])
    table = spark.createDataFrame([(1, 5)], "k bigint, n bigint")
    assert sorted(tuple(r) for r in c.lookup(df, table, "k", "n", 0).collect()) == [(1, "a", 5), (2, "b", 0)]
    assert c.fill(df.withColumnRenamed("v", "w"), labels=["w"], label="x").count() == 2
    both = c.union_layers(df, table)
    assert both.columns == ["k", "v", "n"] and both.count() == 3


def test_scaling_has_no_mean_unit_population_deviation_and_zero_constants(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), 3.0, float("nan") if i % 50 == 0 else float(i)) for i, a in enumerate(rng.normal(9, 4, 300))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = np.array([list(r) for r in prep.standard_scale(df, ["a", "b", "c"]).collect()])
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(got.std(axis=0), [1, 0, 1], atol=1e-9)


def test_split_depends_on_nothing_but_seed_and_key(spark):
    df = spark.range(4000).withColumnRenamed("id", "key")

    def test_ids(frame, **kw):
        return {r[0] for r in prep.split(frame, "key", **kw)[1].collect()}

    one = test_ids(df, test_size=0.15)
    assert one == test_ids(df.repartition(13).orderBy("key", ascending=False), test_size=0.15)
    assert 480 < len(one) < 720 and one != test_ids(df, test_size=0.15, seed=1)
    train, held = prep.split(df, "key", 0.15)
    assert train.count() + held.count() == 4000
    folds = {r["fold"]: r["count"] for r in prep.with_fold(df, "key").groupBy("fold").count().collect()}
    assert sorted(folds) == [0, 1, 2, 3, 4] and min(folds.values()) > 700


def predictions(spark, y, p, model="m"):
    return spark.createDataFrame([(model, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "model string, id bigint, y_true double, y_pred double")


def test_metrics_match_numpy_and_guard_a_constant_target(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(50, 20, 400), rng.normal(50, 20, 400)
    r = m.regression_metrics(predictions(spark, y, p)).first()
    assert r["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert r["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert m.regression_metrics(predictions(spark, [3, 3], [1, 2])).first()["r2"] is None


def test_hexagons_hold_every_point_once_and_survive_no_range(spark):
    rng = np.random.default_rng(6)
    y, p = rng.normal(50, 20, 3000), rng.normal(50, 20, 3000)
    cells = m.hex_density(predictions(spark, y, p)).collect()
    assert sum(r["n"] for r in cells) == 3000
    assert all(r["log_n"] == pytest.approx(math.log10(r["n"])) for r in cells)
    assert max(r["hx"] for r in cells) <= 100 and max(r["hy"] for r in cells) <= 57
    assert [r["n"] for r in m.hex_density(predictions(spark, [2, 2], [2, 2])).collect()] == [2]


def test_profile_counts_values_and_skips_nested_extremes(spark):
    df = spark.createDataFrame([(1, "b", [1]), (2, None, [2])], "k bigint, v string, g array<int>")
    got = {r["column"]: r for r in pf.layer_profile(df).collect()}
    assert (got["v"]["n_rows"], got["v"]["n_values"], got["v"]["smallest"]) == (2, 1, "b")
    assert (got["k"]["smallest"], got["k"]["largest"]) == ("1", "2")
    assert got["g"]["smallest"] is None and got["g"]["type"] == "array<int>"


def test_file_stem_cuts_folders_and_the_last_suffix(spark):
    paths = ["a/b/c.shp", "c.tar.gz", "x/noext", "/deep/dir/shop name.geojson"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = [tuple(r) for r in df.orderBy("i").selectExpr(pf.file_stem("p"), pf.parent_folder("p")).collect()]
    assert got == [("c", "b"), ("c.tar", ""), ("noext", "x"), ("shop name", "dir")]


def test_white_space_of_any_kind_is_trimmed(spark):
    df = spark.createDataFrame([("5\t", " 7\n"), (" 8", "\r9.5"), ("\x0b1\x0c", "2")], "a string, b string")
    kinds = c.column_kinds(df)
    assert kinds == {"a": "bigint", "b": "double"}
    assert [tuple(r) for r in c.to_numeric(df, kinds).collect()] == [(5, 7.0), (8, 9.5), (1, 2.0)]


@pytest.mark.parametrize("values", [
    [float(i % 7) for i in range(3000)], [1.0] * 1500 + [2.0] * 1500, [float(i) ** 3 for i in range(3001)],
    [float("nan"), None, 5.0], [0.0] * 2999 + [1e300], [float("-inf")] + [1.5] * 10 + [float("inf")] * 3])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.99, 1.0])
def test_quantile_in_rounds(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    kept = sorted(v for v in values if v is not None and v == v)
    at = q * (len(kept) - 1)
    low, high = kept[int(at)], kept[min(int(at) + 1, len(kept) - 1)]
    expected = low if low == high else low + (at - int(at)) * (high - low)
    for few in (100_000, 1):
        got = c.exact_quantile(df, "v", q, few).first()[0]
        assert got == pytest.approx(expected, nan_ok=True)


def test_both_ways_of_encoding_give_the_same(spark):
    rows = [(i, None if i % 5 == 0 else f"x{i % 13}", "MISSING" if i % 4 == 0 else f"{i % 3}y", i * 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, v double").repartition(4)
    codes = c.label_dictionary(df, ["a", "b"])
    small = c.encode_labels(df, ["a", "b"], codes)
    large = c.encode_labels(df, ["a", "b"], codes, small=0)
    assert small.schema.simpleString() == large.schema.simpleString()
    assert sorted(small.collect()) == sorted(large.collect()) and large.filter("a IS NULL OR b IS NULL").isEmpty()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = c.encode_labels(df, ["a", "b"], codes, small=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin [_column") == 1


@pytest.mark.parametrize("few", [100, 100_000])
def test_a_quantile_reads_its_table_twice(spark, few):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(4)
    values = rng.normal(size=30_000).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4).mapInArrow(counted, "v double")
    for q in (0.5, 0.99):
        seen.value = 0
        assert c.exact_quantile(df, "v", q, few).first()[0] == pytest.approx(np.quantile(values, q), rel=1e-12)
        assert seen.value == 2 * len(values)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(c, "_MARGIN", -0.2)
    df = spark.createDataFrame([(float(i * 31 % 5000),) for i in range(5000)], "v double")
    assert c.exact_quantile(df, "v", 0.5, 50).first()[0] == 2499.5


@pytest.mark.parametrize("rows,share,want", [(1, 0.15, 1), (20, 0.15, 3), (1000, 0.15, 150), (1001, 0.15, 151), (777, 0.3, 234), (10, 0.0, 0), (10, 1.0, 10)])
def test_a_split_of_exact_size(spark, rows, share, want):
    df = spark.range(rows).withColumnRenamed("id", "k").repartition(3)
    got = prep.split_exact(df, "k", share, seed=4)
    order = sorted(range(rows), key=lambda k: (int(hashlib.md5(f"4:{k}".encode()).hexdigest()[:15], 16), k))
    assert {r["k"] for r in got.filter("is_test").collect()} == set(order[:want]) and got.count() == rows
    assert prep.split_exact(df.limit(0), "k", share).count() == 0


def test_equal_hashes_are_told_apart_by_key(spark, monkeypatch):
    monkeypatch.setattr(prep, "hash_whole", lambda key, seed: "CAST(7 + (k % 2) AS BIGINT)")
    df = spark.createDataFrame([(k,) for k in [*range(40), None]], "k bigint")
    got = prep.split_exact(df, "k", 0.3)
    assert sorted(r["k"] for r in got.filter("is_test").collect()) == list(range(0, 26, 2))
    twice = df.filter("k = 0").unionByName(df.filter("k = 0"))
    assert prep.split_exact(twice, "k", 0.5).filter("is_test").count() == 0
