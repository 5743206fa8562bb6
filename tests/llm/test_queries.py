"""The registered queries have the columns of the task and run on the smallest tables."""

import os

import pytest

from adlens.llm.queries import QUERIES, SQL
from tests.oracle import ROOT, spark_rows, sql_rows

SMALL = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
COLUMNS = {
    "p1_found": {"src": "string", "rec_id": "bigint"},
    "p2_found": {"root_id": "bigint", "vec_id": "bigint"},
    "p3_found": {"vec_a": "bigint", "vec_b": "bigint"},
    "p4_found": {"src": "string", "rec_id": "bigint", "pos": "int", "kw_id": "bigint"},
    "p5_found": {"src": "string", "rec_id": "bigint"},
    "p7_found": {"src": "string", "rec_id": "bigint", "line_no": "int"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "pii_kind": "string", "start_at": "int"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert len(set(map(tuple, rows))) == len(rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == sql_rows(SQL[name], SMALL)


def test_twins_have_queries():
    assert set(SQL) <= set(QUERIES)
