"""The training-data queries that SQL can express."""

import os

import pytest
from oracle import DATA, compare

from svloom.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])
