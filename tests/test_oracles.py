"""Every registered query against its SQL, over the whole small tables."""

import pytest

from transmuta.plans.registry import ORACLES, QUERIES
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_statement_of_its_result():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None
