"""Upserts of alerts with their lists, also after a killed write; the longest word in both ways."""

from __future__ import annotations

import random

import pytest

from wiretally.operators import dga
from wiretally.session import fresh_path
from wiretally.sources import store

ALERTS = "alert_id string, severity string, asset_criticality string, correlation_id string, supporting_evidence string, pcap_id string, detector string"


def _alert(n, severity, capture, detector="d"):
    return (f"a{n}", severity, None, None, None, capture, detector)


def _state(spark, path):
    alerts, lists = store.read_alerts(spark, path, ALERTS)
    return {(r.alert_id, r.severity, r.pcap_id, r.detector) for r in alerts.collect()}, {tuple(r) for r in lists.select("alert_id", "list", "item").collect()}


def test_upsert_replaces_both_lists_and_survives_a_killed_write(spark):
    path = fresh_path(spark, "store")
    frame = lambda rows: spark.createDataFrame(rows, ALERTS)
    lists = lambda rows: spark.createDataFrame(rows, store.LISTS)
    assert _state(spark, path) == (set(), set())
    first = [_alert(1, "low", "c1"), _alert(2, "low", "c1"), _alert(3, "low", "c2"), _alert(4, "low", None)]
    items = [(f"a{n}", kind, f"{kind}-{n}") for n in (1, 2, 3, 4) for kind in ("raw_alert_ids", "correlated_ids")]
    assert store.upsert_with_lists(spark, path, frame(first), lists([*items, items[0], ("a9", "raw_alert_ids", "x")])) == 1
    assert _state(spark, path) == ({(r[0], "low", r[5], "d") for r in first}, set(items))

    again = [_alert(1, "high", "c3", "other"), _alert(4, "high", None, "other"), _alert(5, "high", "c1")]
    fresh = [("a1", "raw_alert_ids", "new"), ("a5", "correlated_ids", "new")]
    before = _state(spark, path)
    # A write that was killed before its manifest: folders of the next version, of another content.
    frame(again[:1]).selectExpr("*", "'pc1' AS part").write.partitionBy("part").parquet(f"{path}/alerts/version=2")
    assert _state(spark, path) == before
    assert store.upsert_with_lists(spark, path, frame(again), lists(fresh)) == 2
    alerts, left = _state(spark, path)
    assert alerts == {("a1", "high", "c3", "d"), ("a2", "low", "c1", "d"), ("a3", "low", "c2", "d"), ("a4", "high", None, "d"), ("a5", "high", "c1", "d")}
    assert left == {i for i in items if i[0] in ("a2", "a3")} | set(fresh)
    assert store.upsert_with_lists(spark, path, frame([]), lists([])) == 3
    assert _state(spark, path) == (alerts, left)


@pytest.mark.parametrize("bound", [0, dga.AUTOMATON_BYTES])
def test_longest_word(spark, bound):
    rng = random.Random(2)
    text = lambda low, high: "".join(rng.choice("abé1") for _ in range(rng.randint(low, high)))
    labels = sorted({text(1, 63) for _ in range(200)} | {"b", "x" * 80})
    words = [text(1, 9) for _ in range(300)] + ["x" * 63, "x" * 64, "ab"]
    got = dga.longest_word_ratio(spark.createDataFrame([(v,) for v in labels], "label string"), spark.createDataFrame([(v,) for v in words], "word string"), bound)
    listed = {w for w in words if 3 <= len(w) <= 63}
    want = {v: round(max((len(w) for w in listed if w in v), default=0) / len(v), 6) for v in labels}
    assert {r.label: r.longest_word_ratio for r in got.collect()} == want


def test_no_words(spark):
    labels = spark.createDataFrame([("abc",)], "label string")
    assert dga.longest_word_ratio(labels, spark.createDataFrame([], "word string")).first().longest_word_ratio == 0
