import pytest

from siltstone.plans import catalog, contracts, files, judging, more, planner, selection  # noqa: F401
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, db, name):
    assert difference(spark, db, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
