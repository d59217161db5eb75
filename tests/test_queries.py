import pytest

from sparkwhy import queries
from tests.duck import connect, same_rows

queries.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    same_rows(queries.QUERIES[name](spark, sf), con, queries.SQL[name])


@pytest.mark.parametrize("name", ["jg_cost", "rf_importance"])
def test_query_without_sql_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_correlated_variables_share_a_cluster(spark, sf):
    found = {r["variable"]: r["cluster"] for r in queries.QUERIES["var_clusters"](spark, sf).collect()}
    assert found["l_quantity"] == found["l_extendedprice"] != found["l_tax"]


def test_entry_returns_patterns(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
