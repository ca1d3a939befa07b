"""Every registered query equals its DuckDB oracle on the sf0.01 tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck
from tests.conftest import SF01
from tiffin.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_catalogue_key_has_an_oracle():
    assert set(CATALOG) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(CATALOG))
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(spark, con, key, SF01)
    assert ok, msg


@pytest.fixture()
def no_estimated_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("key", sorted(CATALOG))
def test_query_matches_oracle_with_at_scale_plans(spark, con, no_estimated_broadcasts, key):
    # The plans of a cluster where every table is large: shuffle joins, and
    # every checked broadcast bound failing.
    ok, msg = compare(spark, con, key, SF01, at_scale=True)
    assert ok, msg
