import pytest
from oracle import compare, connect

from conftest import DATA
from quillspark import catalog


@pytest.fixture(scope="module")
def con():
    return connect(DATA / "sf0.01")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, con, name):
    assert compare(catalog.QUERIES[name](spark, str(DATA / "sf0.01")), catalog.ORACLES[name], con) == ""
