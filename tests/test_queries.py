"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, open_tables

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return open_tables(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    status, _, _, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert status in ("match", "rows-only"), note


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "cohort_definition_id"
