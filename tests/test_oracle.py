"""Every registered query against its SQL, over whole tables of the smallest folder."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from tradeweave.plans.catalog import QUERIES
from tradeweave.plans.oracle import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    yield connect(FOLDER)
    spark.conf.set("spark.sql.adaptive.enabled", "false")


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    verdict, _, _ = compare(spark, db, FOLDER, name)
    assert verdict == ("ok" if name in oracle_sql() else "rows only")


def test_entry(spark):
    assert entry(spark).count() == 20


def test_every_core_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
