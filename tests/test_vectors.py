"""Hand-computed values for the expression layer."""

from __future__ import annotations

from pyspark.sql import functions as F
import pytest

from wiretally.config import BeaconConfig, Thresholds
from wiretally.functions import beaconmath as bm
from wiretally.functions.formats import readable_bytes, severity_band, time_ago
from wiretally.functions.stats import char_entropy, entropy, running_sum
from wiretally.operators import dga, exfil, flow, tls


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def arr(values):
    return F.array(*[F.lit(v) for v in values])


def test_quartiles(spark):
    for values, want in (
        ([98, 99, 99, 100, 100, 100, 101, 101, 102], (99, 100, 101)),
        ([1, 2, 25, 42, 90, 299, 500, 1500, 4975], (13.5, 90, 1000)),
    ):
        q1, q2, q3 = bm.quartiles(arr(values))
        assert tuple(one(spark, a=q1, b=q2, c=q3)) == want


def score(spark, values, default=1.0):
    x = arr(values)
    q1, q2, q3 = bm.quartiles(x)
    row = one(spark, q1=q1, q2=q2, q3=q3, mad=bm.mad(x, q2))
    skew = bm.bowley_skew(F.lit(row.q1), F.lit(row.q2), F.lit(row.q3))
    part = bm.mad_score(F.lit(row.q2), F.lit(row.mad), default)
    return row.mad, one(spark, s=bm.statistical_score(skew, part), k=skew)


def test_statistical_scores(spark):
    mad, row = score(spark, [98, 99, 99, 100, 100, 100, 101, 101, 102])
    assert (mad, row.s) == (1, 0.995)
    mad, row = score(spark, [98] * 5 + [300] * 5)
    assert (mad, row.k, row.s) == (101, 0, 0.746)
    assert score(spark, [1] * 9)[1].s == 1


def test_histogram(spark):
    edges = [bm.bin_index(F.lit(t), F.lit(0), F.lit(50), 5) for t in (1, 5, 23, 25, 42, 45, 50, -3)]
    bins = list(one(spark, **{f"b{i}": e for i, e in enumerate(edges)}))
    assert bins == [0, 0, 2, 2, 4, 4, 4, 0]


def test_longest_run_wraps(spark):
    hist = arr([1, 1, 0, 0, 1, 1])
    assert one(spark, r=bm.longest_run(hist, 6)).r == 4
    assert one(spark, r=bm.longest_run(arr([1] * 6), 6)).r == 6


def test_bimodal_and_cv(spark):
    hist = arr([10, 20] * 12)
    counts = bm.frequency_counts(bm.frequency_groups(hist, 0.05))
    row = one(spark, b=bm.bimodal_score(counts, bm.total_bars(hist), BeaconConfig()), c=bm.cv_score(arr([7] * 24)))
    assert (row.b, row.c) == (1.0, 1.0)


def test_bucket_score(spark):
    t = Thresholds(10, 20, 40, 80)
    got = [one(spark, s=bm.bucket_score(F.lit(v), t)).s for v in (9, 10, 20, 40, 80, 160)]
    assert got == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 0.8])


def test_bands(spark):
    got = [one(spark, s=severity_band(F.lit(v))).s for v in (0.81, 0.8, 0.6, 0.4, 0.2, 0.19)]
    assert got == ["critical", "high", "high", "medium", "low", "none"]


def test_display(spark):
    assert one(spark, s=readable_bytes(F.lit(1536))).s == "1.50 KiB"
    ages = {59: "0 minutes ago", 60: "1 minute ago", 3600: "1 hour ago", 90000: "1 day ago", 720 * 3600: "1 month ago", 2 * 8760 * 3600: "2 years ago"}
    for seconds, text in ages.items():
        assert one(spark, s=time_ago(F.lit(seconds))).s == text


CONN = "uid string, ts timestamp, src string, dst string, dst_port int, proto string, service string, duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, orig_ip_bytes bigint, resp_ip_bytes bigint, conn_state string, missed_bytes bigint"


def conn(spark, rows):
    made = [
        (str(i), None, r.get("src", "10.0.0.1"), r.get("dst", "d"), 80, "tcp", "", r.get("dur", 1.0), r.get("ob", 0), r.get("rb", 0), r.get("op", 0), r.get("rp", 0), r.get("oi", 0), r.get("ri", 0), r.get("state", "SF"), 0)
        for i, r in enumerate(rows)
    ]
    times = spark.createDataFrame([(str(i), float(r.get("ts", 0))) for i, r in enumerate(rows)], "uid string, t double")
    frame = spark.createDataFrame(made, CONN).drop("ts").join(times, "uid")
    return frame.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint"))).drop("t")


def test_flow_window_vector(spark):
    w = flow.flow_windows(conn(spark, [dict(ts=3, op=5, rp=3, oi=500, ri=300)]), 10).first()
    assert (w.packet_count, w.byte_count, w.pkt_rate, w.byte_rate) == (8, 800, 0.8, 80.0)


def test_window_border(spark):
    w = flow.flow_windows(conn(spark, [dict(ts=4.999), dict(ts=5.0), dict(ts=5.001)]), 5)
    assert [r.flow_count for r in w.orderBy("window_start").collect()] == [1, 2]


def test_entropy_of_four_sources(spark):
    w = flow.flow_windows(conn(spark, [dict(src=f"s{i}") for i in range(4)]), 10).first()
    assert w.src_ip_entropy == pytest.approx(2.0)
    e = entropy(spark.createDataFrame([("k", c) for c in "aabb"], "k string, c string"), ["k"], "c").first()
    assert e.entropy == pytest.approx(1.0)


def test_flow_features_vector(spark):
    f = flow.flow_features(conn(spark, [dict(dur=2.0, oi=1400, ri=700, op=10, rp=5)])).first()
    assert (f.byte_rate, f.packet_rate, f.byte_ratio, f.packet_ratio) == (1050.0, 7.5, 2.0, 2.0)


def test_tls_vector(spark):
    f = tls.tls_features(conn(spark, [dict(ob=16000, rb=4000, op=16, rp=4)])).first()
    assert (f.mean_packet_size, f.byte_ratio) == (1000.0, 4.0)


def test_dga_vectors(spark):
    rows = spark.createDataFrame([(x,) for x in ("apple", "bcdfgh", "aei", "a1b2")], "label string")
    got = {r.label: r for r in dga.lexical_features(rows).collect()}
    assert got["apple"].vowel_consonant_ratio == 0.666667
    assert got["bcdfgh"].vowel_consonant_ratio == 0
    assert got["aei"].vowel_consonant_ratio == 3.0
    assert got["a1b2"].digit_ratio == 0.5
    assert one(spark, e=char_entropy(F.lit("aabb"))).e == 1.0


def test_exfil_rule(spark):
    c = conn(spark, [dict(dst="8.8.8.8", ob=500_000, rb=100), dict(dst="10.0.0.9", ob=900_000), dict(dst="1.1.1.1", ob=10, rb=1_500_000)])
    w = exfil.exfil_windows(exfil.outbound_only(c))
    found = exfil.detect_exfil(w, exfil.host_baseline(w)).collect()
    assert [(r.dst, r.severity, r.insufficient_baseline) for r in found] == [("8.8.8.8", "critical", True)]


def test_running_sum(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.floor(F.col("id") / 50).alias("b"), F.lit(1).alias("one"))
    got = running_sum(df, ["k"], "b", [F.col("t")], "one", "n")
    assert got.filter(F.col("n") != F.floor(F.col("t") / 3) + 1).count() == 0
