"""The chunked correlation against the plain walk, on random alerts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wiretally.operators.correlate import _walk, chunk_function, correlate


def plain(alerts, window):
    """The rule as stated: anchors in time order, alert by alert."""
    groups = []
    by_source = {}
    for a in alerts:
        by_source.setdefault(a[2], []).append(a)
    for source, rows in by_source.items():
        rows.sort(key=lambda a: a[1])
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and (rows[j][1] - rows[i][1]).total_seconds() <= window:
                j += 1
            if len({r[3] for r in rows[i:j]}) >= 2:
                groups.append(frozenset(r[0] for r in rows[i:j]))
                i = j
            else:
                i += 1
    return set(groups)


def correlated(spark, alerts, window, chunk):
    df = spark.createDataFrame(alerts, "alert_id string, ts timestamp, source string, threat_class string")
    out = correlate(df, window, chunk).filter("correlation_id IS NOT NULL")
    rows = out.groupBy("correlation_id").agg(F.collect_list("alert_id").alias("ids")).collect()
    return {frozenset(r.ids) for r in rows}


@pytest.mark.parametrize("seed,span,count,chunk", [(1, 4000, 120, 300), (2, 40000, 200, 900), (3, 1500, 300, 300), (4, 6000, 150, 3600)])
def test_equals_plain_walk(spark, seed, span, count, chunk):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    alerts = [
        (f"a{i}", start + timedelta(seconds=rng.randrange(span)), rng.choice(["s1", "multiple", "s2"]), rng.choice(["ddos", "dga", "ddos", "ddos"]))
        for i in range(count)
    ]
    assert correlated(spark, alerts, 300, chunk) == plain(list(alerts), 300)


def test_six_minutes_apart_stay_alone(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    alerts = [("a", start, "s", "ddos"), ("b", start + timedelta(minutes=6), "s", "dga")]
    assert correlated(spark, alerts, 300, 3600) == set()


def test_chunks_compose_like_one_walk():
    rng = random.Random(7)
    for _ in range(2000):
        window = rng.randrange(3, 20)
        chunk = rng.randrange(window, 60)
        openers = sorted(rng.sample(range(400), rng.randrange(1, 80)))
        whole = _walk(openers, 0, 400 + chunk, window)
        carry, pieces = 0, []
        for low in range(0, 400 + chunk, chunk):
            part = [t for t in openers if low <= t < low + chunk]
            if not part:
                continue
            entry = max(low, carry)
            pieces += _walk(part, entry, low + chunk, window)
            for upto, leaves in chunk_function(part, low, low + chunk, window):
                if entry <= upto:
                    carry = leaves or carry
                    break
        assert pieces == whole
