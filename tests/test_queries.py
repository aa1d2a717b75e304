import pytest

from quarrylight import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(name, spark, con):
    assert compare(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) is None


def test_every_query_has_sql():
    assert sorted(set(registry.QUERIES) - set(registry.ORACLES)) == []


#: results that are rightly empty on the given tables
EMPTY = {"secret_scan_documents"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - EMPTY))
def test_sql_gives_rows(name, con):
    """A comparison of nothing with nothing proves nothing."""
    assert con.execute(registry.ORACLES[name]).fetchone() is not None
