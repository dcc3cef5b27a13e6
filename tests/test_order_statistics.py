"""Order statistics as relations against sorted lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wiretally.functions.stats import order_statistics
from wiretally.operators import beacons


def median(x):
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 if x else None


def listed(values):
    x = sorted(values)
    half, middle = len(x) // 2, median(x)
    return len(x), median(x[:half]), middle, median(x[(len(x) + 1) // 2 :]), median(sorted(abs(v - middle) for v in x))


def test_against_lists(spark):
    rng = random.Random(3)
    keys = {f"k{n}": [rng.choice([0, 1, 2, 7, 7, 60, 600, -5]) for _ in range(n)] for n in range(1, 40)}
    rows = [(k, v, 1) for k, values in keys.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v long, n long")
    heavy = df.groupBy("k", "v").agg(F.sum("n").alias("n"))
    odd = spark.createDataFrame([("k3", None, 5), ("k4", 9, 0), ("none", None, 1)], "k string, v long, n long")
    for frame in (df, heavy, df.unionByName(odd)):
        got = {r.k: tuple(r)[1:] for r in order_statistics(frame, "k", "v", "n").collect()}
        assert got == {k: listed(v) for k, v in keys.items()}
    assert order_statistics(df.limit(0), "k", "v", "n").collect() == []


def test_a_key_with_80_000_seconds(spark):
    """One key with a second of its own for each connection, beside small ones."""
    steps = spark.range(80_000).select(F.lit("hot").alias("hash"), (F.col("id") + F.floor(F.col("id") / 9)).alias("s"))
    few = spark.range(50).select(F.lit("few").alias("hash"), (F.col("id") * 60).alias("s"))
    seconds = steps.unionByName(few).select("hash", F.timestamp_seconds("s").alias("ts"), F.lit(1).cast("long").alias("n"))
    sizes = seconds.groupBy("hash").agg(F.sum("n").alias("n")).withColumn("src_ip_bytes", F.lit(100).cast("long"))
    span = spark.sql("SELECT timestamp_seconds(0) AS min_ts, timestamp_seconds(88888) AS max_ts")
    keys = seconds.select("hash").distinct()
    got = {r["hash"]: r for r in beacons.score_beacons(beacons.beacon_features(seconds, sizes, keys, span)).collect()}
    s = [n + n // 9 for n in range(80_000)]
    want = listed([b - a for a, b in zip(s, s[1:])])
    hot = got["hot"]
    assert (hot.gap_count, hot.gap_q1, hot.gap_q2, hot.gap_q3, hot.gap_mad) == want
    assert got["few"].gap_q2 == 60 and got["few"].ts_score == pytest.approx(1.0)


def test_no_lists_in_the_plan(spark):
    seconds = spark.sql("SELECT 'a' AS hash, current_timestamp() AS ts, 1L AS n")
    sizes = spark.sql("SELECT 'a' AS hash, 1L AS src_ip_bytes, 1L AS n")
    span = spark.sql("SELECT current_timestamp() AS min_ts, current_timestamp() AS max_ts")
    scored = beacons.score_beacons(beacons.beacon_features(seconds, sizes, seconds.select("hash"), span))
    assert "collect_" not in scored._jdf.queryExecution().optimizedPlan().toString()
