"""Streams over several micro-batches equal the batch operators."""

from __future__ import annotations

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from wiretally.operators import floods, flow
from wiretally.config import FloodConfig
from wiretally.plans import adapters as ad
from wiretally.session import fresh_path
from wiretally.streaming import flows, stateful
from wiretally.streaming.rolling import RollingImport, late_rows

SF = "/root/testdata/sf0.001"


def in_files(df, n, order):
    """The rows as ``n`` files, in time order."""
    path = fresh_path(df.sparkSession, "parts")
    df.repartitionByRange(n, order).write.parquet(path)
    return path


def test_windows_over_batches(spark):
    conn = ad.conn_events(spark, SF)
    path = in_files(conn, 4, "ts")
    stream = spark.readStream.schema(conn.schema).option("maxFilesPerTrigger", 1).parquet(path)
    sink = fresh_path(spark, "sink")
    flows.stream_flow_windows(stream, sink, fresh_path(spark, "ckpt"), 3600, lateness="60 days").awaitTermination()
    keep = ["window_start", "dst", "flow_count", "byte_count", "unique_source_count"]
    got = flows.read_flow_windows(spark, sink, 3600).select(*keep)
    want = flow.flow_windows(conn, 3600).select(*keep)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_closed_windows_are_written_once(spark):
    """Several files, a late record that is dropped and counted, windows that wait for the watermark."""
    conn = ad.conn_events(spark, SF)
    inbox, sink, ckpt = (fresh_path(spark, x) for x in ("inbox", "sink", "ckpt"))
    first = conn.agg(F.min("ts")).first()[0]
    cut = conn.agg(F.percentile_approx(F.unix_seconds("ts"), 0.5)).first()[0]
    early, late = conn.filter(F.unix_seconds("ts") <= cut), conn.filter(F.unix_seconds("ts") > cut)
    again = conn.filter(F.col("ts") == first)
    counts, dropped = [], 0
    for part in (early, late, again, flows.closing_record(conn, 3600, "1 hour")):
        part.repartitionByRange(2, "ts").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(conn.schema).parquet(inbox)
        run = flows.stream_closed_windows(stream, sink, ckpt, 3600, "1 hour")
        run.awaitTermination()
        dropped += late_rows(run)
        counts.append(spark.read.parquet(sink).count())
    assert dropped == again.count() and counts[0] < counts[1] <= counts[2] < counts[3]
    keep = ["window_start", "dst", "flow_count", "byte_count", "unique_source_count"]
    got, want = flows.read_closed_windows(spark, sink, 3600).select(*keep), flow.flow_windows(conn, 3600).select(*keep)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    rows = spark.read.parquet(sink)
    assert rows.count() == rows.select("window_start", "dst", "src").distinct().count()


def test_flood_state_over_batches(spark):
    cfg = FloodConfig(z_threshold=1.5, entropy_z_threshold=0.5)
    windows = flow.flow_windows(ad.conn_events(spark, SF), 6 * 3600).drop("conn_state_counts")
    want = floods.score_windows(windows, cfg).select("dst", "window_start", "baseline_size", "flagged")
    path = fresh_path(spark, "windows")
    sink = fresh_path(spark, "floods")
    ckpt = fresh_path(spark, "ckpt")
    cut = F.lit("2024-01-15").cast("timestamp")
    for part in (windows.filter(F.col("window_start") < cut), windows.filter(F.col("window_start") >= cut)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(windows.schema).parquet(path)
        scored = stateful.stream_flood_scores(stream, cfg)
        run = scored.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).format("parquet").start(sink)
        run.awaitTermination()
    got = spark.read.parquet(sink).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert want.filter("flagged").count() > 0


def _run_parts(spark, schema, parts, operator, checkpoint, sink):
    """Each part of rows is a micro-batch of its own, under one checkpoint."""
    inbox = fresh_path(spark, "inbox")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = operator(spark.readStream.schema(schema).parquet(inbox))
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()
    return spark.read.parquet(sink)


def _day(n, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=n)


def test_findings_change_and_are_forgotten(spark):
    schema = "fingerprint string, ts timestamp, score double, severity string"
    parts = [
        [("a", _day(0), 0.5, "low"), ("b", _day(0), 0.5, "low")],
        [("a", _day(1), 0.6, "low"), ("b", _day(1), 0.7, "low")],  # b rises by 0.2
        [("a", _day(2), 0.6, "high")],  # a escalates
        [("a", _day(10), 0.6, "high"), ("x", _day(10), 0.1, "low")],
        [("x", _day(17), 0.1, "low"), ("a", _day(17), 0.6, "high")],  # b is silent for longer than 14 days
        [("x", _day(18), 0.1, "low")],
        [("b", _day(19), 0.7, "low"), ("a", _day(19), 0.6, "high")],
        [("b", _day(3), 0.1, "low")],  # later than the watermark
    ]
    got = _run_parts(spark, schema, parts, stateful.stream_dedup, fresh_path(spark, "ckpt"), fresh_path(spark, "sink"))
    assert sorted((r.fingerprint, r.ts, r.change_status) for r in got.collect()) == [
        ("a", _day(0), "new_finding"),
        ("a", _day(2), "materially_changed"),
        ("b", _day(0), "new_finding"),
        ("b", _day(1), "materially_changed"),
        ("b", _day(19), "new_finding"),
        ("x", _day(10), "new_finding"),
    ]


def test_flood_baselines_are_forgotten(spark):
    schema = "dst string, window_start timestamp, flow_count long, pkt_rate double, byte_rate double, src_ip_entropy double"
    window = lambda dst, n, h: (dst, _day(n, h), 10, 5.0 + h, 100.0, 1.0)
    parts = [
        [window("a", 0, 0), window("a", 0, 1), window("b", 0, 1)],
        [window("a", 0, 2), window("b", 9, 0)],
        [window("b", 40, 0)],
        [window("b", 41, 0), window("a", 41, 0)],
    ]
    got = _run_parts(spark, schema, parts, stateful.stream_flood_scores, fresh_path(spark, "ckpt"), fresh_path(spark, "sink"))
    assert sorted((r.dst, r.window_start, r.baseline_size) for r in got.collect()) == [
        ("a", _day(0, 0), 0),
        ("a", _day(0, 1), 1),
        ("a", _day(0, 2), 2),
        ("a", _day(41), 0),  # thirty days of silence
        ("b", _day(0, 1), 0),
        ("b", _day(9), 1),
        ("b", _day(40), 2),
        ("b", _day(41), 3),
    ]


def _rolling_rows(kind, rows):
    base = dict(src="10.0.1.3", src_port=40000, dst="198.51.100.7", dst_port=80)
    extra = {
        "conn": dict(proto="tcp", service="http", duration=1.0, orig_bytes=10, resp_bytes=20, orig_pkts=1, resp_pkts=1, orig_ip_bytes=50, resp_ip_bytes=60, conn_state="SF", missed_bytes=0, history="S", is_open=False),
        "http": dict(trans_depth=1, method="GET", host="h.example.com", uri="/", referrer="", user_agent="u", dst_mime_types=["text/html"]),
        "ssl": dict(server_name="s.example.net", ja3="j", ja3s="k", version="TLSv12", validation_status="ok", established=True),
        "dns": dict(query="q.example.org", qtype_name="A", answers=["198.51.100.1"]),
    }[kind]
    return [Row(uid=uid, ts=ts, **base, **extra) for uid, ts in rows]


def test_rolling_import_links_across_chunks_and_counts_late_rows(spark):
    rolling = RollingImport(spark, fresh_path(spark, "rolling"), lateness="1 hour", window="4 hours")
    inbox = fresh_path(spark, "inbox")
    chunks = [
        {"conn": [("c1", _day(0, 1)), ("c2", _day(0, 2))], "http": [("c1", _day(0, 1)), ("c3", _day(0, 3))], "ssl": [("c2", _day(0, 2))], "dns": [("d", _day(0, 1))]},
        {"conn": [("c3", _day(0, 3))], "http": [("c2", _day(0, 3)), ("c2", _day(0, 2))], "ssl": [("c3", _day(0, 3))], "dns": [("d", _day(0, 3))]},
        {"conn": [("c9", _day(1, 1))], "http": [("c9", _day(1, 1))], "ssl": [("c9", _day(1, 1))], "dns": [("d", _day(1, 1))]},
        {"conn": [("c10", _day(1, 2))], "http": [("c3", _day(0, 3)), ("c10", _day(1, 2))], "ssl": [("c10", _day(1, 2))], "dns": [("d", _day(1, 2))]},
    ]
    for rows in chunks:
        streams = {}
        for kind, found in rows.items():
            df = spark.createDataFrame(_rolling_rows(kind, found))
            df = df.withColumns({c: F.col(c).cast("int") for c in ("src_port", "dst_port")})
            df.coalesce(1).write.mode("append").parquet(f"{inbox}/{kind}")
            streams[kind] = spark.readStream.schema(df.schema).parquet(f"{inbox}/{kind}")
        rolling.import_chunk(streams)
    ledger = {(r.chunk, r.log): (r.rows, r.late) for r in rolling.read("ledger").collect()}
    assert [ledger[n, "conn"] for n in (1, 2, 3, 4)] == [(2, 0), (3, 0), (4, 0), (5, 0)]
    assert [ledger[n, "http"][0] for n in (1, 2, 3, 4)] == [1, 4, 5, 6]  # c3 came before its connection
    assert [ledger[n, "http"][1] for n in (1, 2, 3)] == [0, 0, 0] and ledger[4, "http"][1] == 1
    assert [ledger[n, "ssl"] for n in (1, 2, 3, 4)] == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert rolling.last_chunk() == 4
    hours = {r.hour_id for r in rolling.read("conn").select("hour_id").distinct().collect()}
    assert len(hours) == 5


def test_import_over_batches(spark):
    conn = ad.conn_events(spark, SF)
    one, many = fresh_path(spark, "one"), fresh_path(spark, "many")
    from wiretally.operators.normalize import normalize_conn, unfiltered

    nothing = unfiltered(normalize_conn(conn)).filter(F.lit(False))
    results = []
    for store, files in ((one, 1), (many, 5)):
        stream = spark.readStream.schema(conn.schema).option("maxFilesPerTrigger", 1).parquet(in_files(conn, files, "uid"))
        flows.stream_import(stream, store, fresh_path(spark, "ckpt")).awaitTermination()
        results.append(flows.analyse_import(spark, store, nothing).select("hash", "count", "ts_unique", "beacon_score"))
    assert results[0].exceptAll(results[1]).count() == 0 and results[0].count() == results[1].count()
