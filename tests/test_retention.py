"""Lifetimes by whole partitions, and the run of all detectors."""

from __future__ import annotations

import datetime

import __spark_entry__ as entry
from wiretally.operators import alerts as contract
from wiretally.plans import q_detect
from wiretally.session import fresh_path
from wiretally.sources import store


def test_whole_partitions_go_and_the_border_is_rewritten(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(n, start + datetime.timedelta(minutes=20 * n)) for n in range(240)] + [(999, None)]
    df = spark.createDataFrame(rows[:-1], "id long, ts timestamp")
    path = fresh_path(spark, "filed")
    store.write_by_time(df, path, "ts", 3600)
    now = int(datetime.datetime(2024, 1, 4, 8, 10, tzinfo=datetime.timezone.utc).timestamp())
    done = store.drop_expired(spark, path, "ts", 26 * 3600, 3600, now)
    limit = datetime.datetime(2024, 1, 3, 6, 10)
    left = {r.id for r in spark.read.parquet(path).collect()}
    assert left == {i for i, ts in rows[:-1] if ts >= limit}
    assert done == {"dropped": 54, "rewritten": 1}
    assert store.drop_expired(spark, path, "ts", 26 * 3600, 3600, now) == {"dropped": 0, "rewritten": 1}
    assert {r.id for r in spark.read.parquet(path).collect()} == left


def test_all_seven_detectors_run_together(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["f08_run_all_detectors"](spark, sf).collect()
    single = {}
    for make in q_detect.detectors(spark, sf).values():
        valid, _ = contract.validate_alerts(make())
        for r in valid.groupBy("threat_class", "detector", "severity").count().collect():
            single[r[0], r[1], r[2]] = r[3]
    assert {(r.threat_class, r.detector, r.severity): r.alerts for r in got} == single
    assert len(q_detect.detectors(spark, sf)) == 7 and len(single) >= 5
