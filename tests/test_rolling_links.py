"""The rolling import's stream joins hold keys only; linked rows are those of a join of whole rows."""

from __future__ import annotations

import __spark_entry__ as entry
from pyspark.sql import functions as F

from wiretally.operators import linking, normalize
from wiretally.plans import adapters as ad

SF = "/root/testdata/sf0.001"


def test_links_with_repeated_rows_and_nulls(spark):
    entry.configure(spark)
    raw = ad.conn_orders(spark, SF).filter("cast(uid AS long) < 300")
    conn = normalize.normalize_conn(raw.union(raw.filter("cast(uid AS long) < 40")), keep=("is_open",))
    lines = ad.http_lines(spark, SF).filter("cast(uid AS long) < 300")
    lines = lines.union(lines.filter("cast(uid AS long) < 80")).withColumn("referrer", F.expr("if(trans_depth % 2 = 0, NULL, referrer)"))
    log = normalize.normalize_http(lines).drop("hash")
    links = linking.link_stream(log, conn, "1 hour", "4 hours", "is_open")
    assert set(links.columns) == {"zeek_uid", "ts", "mark", "conn_ts", "conn_mark"}
    got = linking.linked_rows(log.withColumn("mark", linking.row_mark(log)), conn, links, "is_open")
    near = F.expr("ts >= conn_ts - INTERVAL 4 hours AND ts <= conn_ts + INTERVAL 4 hours")
    want = log.join(linking.carried(conn, "is_open"), "zeek_uid").filter(near).select(*got.columns)
    assert want.count() == got.count() > log.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
