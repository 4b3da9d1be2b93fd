"""Every registered query against its oracle SQL."""

import pytest

from suite import all_oracles, all_queries
from suite.check import compare_one, oracle
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_oracle(spark, connection, name):
    problem = compare_one(spark, connection, SMALL, all_queries()[name], all_oracles().get(name))
    assert problem is None, problem


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())
