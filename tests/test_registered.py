"""Every registered query with SQL agrees with it on the smallest tables."""

import importlib

import pytest

from tests import oracle

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, rows = oracle.compare(spark, con, name, FOLDER, QUERIES, ORACLES)
    assert verdict in ("ok", "rows-only"), verdict


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 20


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
