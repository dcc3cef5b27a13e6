"""Operators that work in pieces give the results of one pass over everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wiretally.config import FloodConfig
from wiretally.operators import anomaly, evaluate, floods

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _windows(sizes: dict[str, int], seed: int) -> list[tuple]:
    """Flow windows with gaps, quiet stretches and floods, some of them next to a border of chunks."""
    rng = random.Random(seed)
    rows = []
    for dst, n in sizes.items():
        at = 0
        for _ in range(n):
            at += rng.choice((1, 1, 1, 2, 9))
            flood = rng.random() < 0.05
            rate = rng.gauss(100, 5) * (8 if flood else 1)
            entropy = rng.gauss(3, 0.1) - (2 if flood else 0)
            start = START + timedelta(seconds=10 * at)
            rows.append((dst, start, rng.choice((2, 6, 9, 40)), rate, rate * 60, entropy, "kept"))
    return rows


COLUMNS = "dst string, window_start timestamp, flow_count long, pkt_rate double, byte_rate double, src_ip_entropy double, note string"


@pytest.mark.parametrize("rows", [64, 4096])
def test_flood_chunks_equal_one_walk(spark, rows):
    cfg = FloodConfig()
    data = _windows({"10.0.0.1": 500, "10.0.0.2": 200, "10.0.0.3": 3, "10.0.0.4": 60}, seed=rows)
    want = {}
    for dst in sorted({r[0] for r in data}):
        history = floods.new_history(cfg)
        for _, start, flows, *metrics, _ in sorted(r for r in data if r[0] == dst):
            want[dst, int(start.timestamp())] = floods.judge(history, tuple(metrics), flows, cfg)
    got = floods.score_windows(spark.createDataFrame(data, COLUMNS), cfg, rows).withColumn("at", F.unix_seconds("window_start")).collect()
    assert len(got) == len(data) and {r.note for r in got} == {"kept"}
    assert {(r.dst, r.at): (r.baseline_size, r.pkt_z, r.byte_z, r.entropy_z, r.flagged) for r in got} == want
    assert 0 < sum(r.flagged for r in got) < len(data) / 4


def test_hot_destination_is_dealt_to_many_chunks(spark):
    windows = spark.createDataFrame(_windows({"10.0.0.1": 3000, "10.0.0.2": 100}, seed=1), COLUMNS)
    sizes = floods._chunked(windows, FloodConfig(), 256).groupBy("dst", "chunk").count().where("dst = '10.0.0.1'").collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) <= 2 * 256


def test_no_windows(spark):
    assert floods.score_windows(spark.createDataFrame([], COLUMNS)).collect() == []


def test_ranking_of_any_range(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), rng.choice((-1e9, -3.5, 0.0, 0.25, 7e12)) + rng.randrange(20)) for _ in range(3000)]
    rows += [(None, 1.0), (1, None)]
    got = evaluate.ranking_scores(spark.createDataFrame(rows, "y int, s double").repartition(7), "y", "s").first()
    known = [(y == 1, s) for y, s in rows if s is not None]
    hits, misses = [s for y, s in known if y], [s for y, s in known if not y]
    area = sum((h > m) + (h == m) / 2 for h in hits for m in misses) / (len(hits) * len(misses))
    precision = sum(sum(x >= h for x in hits) / sum(s >= h for _, s in known) for h in hits) / len(hits)
    assert (got.positives, got.negatives) == (len(hits), len(misses))
    assert got.roc_auc == pytest.approx(area) and got.pr_auc == pytest.approx(precision)


def test_forest_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(f"u{n}", [float(rng.randrange(9)), rng.gauss(0, 1)]) for n in range(2000)]
    data = spark.createDataFrame(rows, "uid string, x array<double>")
    few = anomaly.train_forest(data.repartition(4), trees=20)
    many = anomaly.train_forest(data.orderBy(F.desc("uid")).repartition(53), trees=20)
    key = ["tree", "node"]
    assert few.nodes.sort_values(key).reset_index(drop=True).equals(many.nodes.sort_values(key).reset_index(drop=True))
