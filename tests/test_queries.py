import pytest

from ledgerstone.plans import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, duck):
    same_rows(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
