import pytest

from brindle.plans import registry
from tests.compare import duck, same


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, con, name):
    same(registry.QUERIES[name](spark, small), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert set(df.columns) >= {"query_id", "chunk_id", "rank"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
