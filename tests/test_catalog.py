import pytest

from millrace.plans import catalog
from tests.oracle import duck, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, con, name):
    assert same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) > 0
