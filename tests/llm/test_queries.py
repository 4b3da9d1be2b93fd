"""Every registered query of the subpackage against its SQL or a brute-force count of rows."""

import pytest

from gleanframe.llm.queries import QUERIES
from suite.check import compare_one, oracle
from tests.conftest import SMALL


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_query_matches_its_sql(spark, name):
    run, sql = QUERIES[name]
    problem = compare_one(spark, oracle(SMALL), SMALL, run, sql)
    assert problem is None, problem


def test_there_is_a_query_for_every_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
