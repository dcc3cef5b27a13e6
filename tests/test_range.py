"""The range of an analysis: only the last day's logs count, open-only pairs included."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import anomaly, hourly, rollups
from wiretally.plans import q_hourly as qh
from wiretally.plans import q_logs as ql
from wiretally.plans import q_scores as qs
from wiretally.plans.logs import OrderLogs, RecentLogs, stored_logs

SF = "/root/testdata/sf0.001"


def test_older_days_do_not_count(spark):
    logs = stored_logs(spark, SF)
    start = qs.ip_span(logs).select("min_ts").first()[0]
    longer = OrderLogs(spark, SF)
    for name in ("http", "open_http", "ssl", "open_ssl", "conn", "open_conn", "dns"):
        rows = getattr(logs, name)
        older = [rows.withColumn("ts", F.col("ts") - F.expr(f"INTERVAL {days} DAYS")) for days in (1, 2)]
        longer.__dict__[name] = rows.union(older[0].filter(F.col("ts") < F.date_trunc("hour", F.lit(start)))).union(older[1])
    recent = RecentLogs(longer, start)
    assert longer.conn.count() > 2 * logs.conn.count() - 10
    for name in ("uconn", "usni", "udns"):
        assert sorted(map(str, getattr(recent, name).collect())) == sorted(map(str, getattr(logs, name).collect()))
    assert sorted(map(str, qh.rollup_ip(recent).collect())) == sorted(map(str, qh.rollup_ip(logs).collect()))


def test_open_only_pairs_are_scored(spark):
    logs = stored_logs(spark, SF)
    opened = logs.open_conn.join(logs.conn, "hash", "left_anti").select("hash").distinct()
    keys = ql.linking.ip_only_keys(ql.pair_keys(logs), ql.sni_uids(logs))
    assert opened.count() and opened.join(keys, "hash", "left_anti").count() == 0
    assert qs.scored_rows(logs).join(opened, "hash", "left_semi").count() > 0


def test_lists_are_whole_unless_capped(spark):
    rows = spark.createDataFrame([("k", f"10.0.0.{n}") for n in range(30)], "hash string, dst string")
    assert len(hourly.value_list(rows, ["hash"], "dst", "all").first()["all"]) == 30
    assert len(hourly.value_list(rows, ["hash"], "dst", "all", cap=10).first()["all"]) == 10
    assert rollups.value_list is hourly.value_list


def test_each_tree_samples_all_rows(spark):
    rows = spark.range(6000).select(F.array(F.col("id").cast("double")).alias("x"))
    sizes = anomaly._sampled(rows, 40, 256, 6000, 1).groupBy("tree").count().collect()
    assert len(sizes) == 40 and all(150 < r["count"] < 400 for r in sizes)


def test_a_failing_detector_does_not_stop_the_others(spark):
    from wiretally.operators.runner import run_detectors

    good = lambda: spark.range(3).withColumnRenamed("id", "alert")
    broken = lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("alert"))
    alerts, status = run_detectors(spark, {"a": good, "b": broken, "c": good})
    assert alerts.count() == 6
    assert {r.detector: (r.status, r.alerts) for r in status.collect()} == {"a": ("ok", 3), "b": ("failed", None), "c": ("ok", 3)}
    assert run_detectors(spark, {"b": broken})[0] is None
