"""Every query against its SQL on DuckDB, and the driver contract."""

import pytest

import __spark_entry__ as entry_point
from checks import catalog
from checks.compare import difference, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF, name) is None


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    flagship = entry_point.entry(spark)
    assert flagship.columns[0] == "evento_id" and flagship.count() == 25
