"""Every registered query over the reference tables against its SQL."""

from __future__ import annotations

import pytest
from oracle import rows_of, sql_rows

from brinewell.plans.catalog import QUERIES, SQL

WITHOUT_SQL = {"approx_distinct_native", "cms_native"}


def test_sql_covers_the_catalog():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    names, got = rows_of(QUERIES[name](spark, sf_dir))
    sql_names, expected = sql_rows(SQL[name], sf_dir)
    assert names == sql_names
    assert got == expected
    assert got


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
