"""Queries without a DuckDB statement run and give rows."""

import pytest

from conftest import DATA
from quillspark import catalog


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0
