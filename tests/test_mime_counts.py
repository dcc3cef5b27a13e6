"""MIME mismatches per key are counted without rows per hour and URI, and equal the sums of such rows."""

from __future__ import annotations

import __spark_entry__ as entry
from pyspark.sql import functions as F

from wiretally.operators import hourly
from wiretally.plans import adapters as ad
from wiretally.plans.logs import OrderLogs

SF = "/root/testdata/sf0.001"


def test_counts_are_the_sums(spark):
    http, valid = OrderLogs(entry.configure(spark), SF).http, ad.valid_mime(spark)
    rows = hourly.agg_mime_uris(http, valid)
    want = {r.hash: r.n for r in rows.groupBy("hash").agg(F.sum("mismatch_count").alias("n")).collect()}
    counts = hourly.count_mime_mismatches(http, valid)
    assert {r.hash: r.mismatch_count for r in counts.collect()} == want and want
    assert counts.columns == ["hash", "mismatch_count"]
