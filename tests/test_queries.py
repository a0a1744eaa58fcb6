"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest
from check import compare

import __spark_entry__ as entry
from foliomill.plans.registry import all_queries, all_sql

NAMES = list(all_queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    assert ok, note


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
