import pytest

from tessera.plans.registry import ORACLES, QUERIES
from tests.compare import check

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, name, QUERIES[name], ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
