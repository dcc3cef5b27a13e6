"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from wiretally.plans import registry

SF = "/root/testdata/sf0.001"
# Text operators have tests of their own.
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in registry.queries()}
QUERIES = {name: query for name, query in entry.queries().items() if name in registry.queries()}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).to_arrow_table()
        assert compare(got, want) is None
    else:
        assert got.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
