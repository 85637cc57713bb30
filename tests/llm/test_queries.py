"""The registered queries against their SQL on the smallest tables."""

import os

import pytest
from oracle import compare, duck

from wardlight.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    ok, text = compare(spark, duck(SF), queries.QUERIES[name], queries.ORACLES.get(name), SF)
    assert ok, text
