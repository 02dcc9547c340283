"""Every query that SQL can express, in Spark and in DuckDB, on the smallest tables."""

import pytest

from checks import compare
from checks.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_spark_and_duckdb_agree(spark, duck, name):
    ok, note = compare.compare(spark, duck, SF, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
