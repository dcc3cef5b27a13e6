"""Halves: scores of three decimals and the newest record's second are rounded like the SQL's."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """All prices whose score ends in half a thousandth; a newest event seven tenths into the second of a border."""
    folder = str(tmp_path_factory.mktemp("halves"))
    for name in os.listdir(SF):
        if name not in ("orders.parquet", "events.parquet"):
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT i AS o_orderkey, i % 20 AS o_custkey, o_orderstatus, (i * 500 + 250)::DOUBLE AS o_totalprice, o_orderdate, o_orderpriority
        FROM range(900) r(i) CROSS JOIN (SELECT * FROM '{SF}/orders.parquet' LIMIT 1)) TO '{folder}/orders.parquet'"""
    )
    con.execute(
        f"""COPY (SELECT e.* REPLACE (i AS event_id, TIMESTAMP '2024-01-30 12:00:00.7' - to_seconds(i) AS ts)
        FROM range(100000) r(i) CROSS JOIN (SELECT * FROM '{SF}/events.parquet' LIMIT 1) e) TO '{folder}/events.parquet'"""
    )
    return folder


@pytest.mark.parametrize("name", ("p27_normalize_findings", "s10_read_findings_csv", "s24_drop_expired"))
def test_against_sql(name, spark, halves):
    got = entry.queries()[name](spark, halves).toArrow()
    assert compare(got, connect(halves).execute(entry.oracle_sql()[name]).to_arrow_table()) is None
