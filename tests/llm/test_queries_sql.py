"""The registered queries: all there, and equal to their SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import compare, connect
from veritrail.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    known = queries()
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(known) and set(CHECKS) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    problem, rows = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], CHECKS[name])
    assert problem is None and rows > 0, problem
