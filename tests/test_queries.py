"""Every registered query that has SQL gives the rows DuckDB gives; the others are held against planted truth in test_kernels."""

import pytest

from nightloom import catalog
from tests.compare import DATA, check

#: A plane of the smallest tables is too sparse to be registered.
LARGER = {"phase_correlation": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.ORACLES[name], LARGER.get(name, DATA))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0
