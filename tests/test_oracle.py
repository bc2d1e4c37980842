"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


#: Queries that find nothing in the smallest tables; they run on the next larger ones.
SPARSE = {"det_lateral", "det_scanning", "det_sequence", "stream_sequence"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, small, key):
    tables = small.replace("0.001", "0.01") if key in SPARSE else small
    found = difference(QUERIES[key](spark, tables), connect(tables), ORACLES[key])
    assert found is None, found


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, small, key):
    assert QUERIES[key](spark, small).columns


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
