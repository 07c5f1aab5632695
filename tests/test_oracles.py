import pytest

from skein.plans.queries import oracle_sql, queries

from .oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, con, name):
    compare(spark, con, queries()[name], oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
