"""Every core query with an SQL twin gives the twin's rows; every other one runs."""

import os

import pytest

from adlens.plans import core
from tests.oracle import ROOT, spark_rows, sql_rows

SMALL = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_twin(spark, name):
    assert spark_rows(core.QUERIES[name](spark, SMALL)) == sql_rows(core.SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    df = core.QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_twins_have_queries():
    assert set(core.SQL) <= set(core.QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
