"""Every registered query of the kernels and of the language against its SQL."""

import os

import pytest
from oracle import DATA, compare

from svloom.plans import lane_a, lane_b

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_lanes_are_registered():
    assert lane_a.TOP and {"sv_elaborate", "asof_last"} <= lane_b.QUERIES.keys()
    assert lane_b.ORACLES.keys() == lane_b.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(lane_b.ORACLES))
def test_oracle(spark, name):
    compare(spark, lane_b.QUERIES[name], lane_b.ORACLES[name])
