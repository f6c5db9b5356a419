"""Every query against its SQL twin."""

import pytest
from compare import connect, same

from waveplan.plans.catalog import QUERIES
from waveplan.plans.oracle import ORACLES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, small, name):
    same(QUERIES[name](spark, small), con, ORACLES[name])


@pytest.mark.parametrize("name", ["wave_summary", "assigned", "scenario_sweep", "carton_running_scaled"])
def test_matches_oracle_on_more_rows(spark, medium, name):
    same(QUERIES[name](spark, medium), connect(medium), ORACLES[name])
