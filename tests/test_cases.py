import pytest

from tests.cases import CASES, EXPECTED
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(name, spark, con):
    assert compare(CASES[name](spark, "/root/testdata/sf0.001"), con, EXPECTED[name]) is None
