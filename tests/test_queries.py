"""Every registered query of the general package against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from sorrel.plans import catalog

from .compare import connection, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_agree(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert not differences(df, catalog.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    n = catalog.QUERIES[name](spark, sf_dir).count()
    assert n > 0 or name == "assigned_customers"  # the smallest tables' ten suppliers have no customer near enough
