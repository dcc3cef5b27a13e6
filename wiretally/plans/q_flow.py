"""Queries over flows: windows, features, traffic reports, exfiltration, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.config import ExfilConfig, ScanConfig
from wiretally.functions.formats import readable_bytes
from wiretally.functions.stats import entropy
from wiretally.operators import exfil, flow, scan
from wiretally.plans.adapters import conn_events, conn_lines, dns_pages, sec, sql, ssl_orders

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

W = 3600
_EXFIL = ExfilConfig(window_seconds=W)


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = sql(oracle, extra)
        return function

    return register


def secs(column: str):
    return F.unix_seconds(column).alias(column)


_X = {
    "win": f"SELECT *, {sec('ts')} // {W} * {W} AS w FROM conn_events",
    "win_src": """SELECT w, dst, src, count(*) AS n FROM win GROUP BY ALL""",
    "win_entropy": """SELECT w, dst, count(*) AS unique_source_count,
        CASE WHEN count(*) <= 1 THEN 0.0
          ELSE greatest(0.0, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) / sum(n)) END AS ent
        FROM win_src GROUP BY ALL""",
}

_SYN = "proto = 'tcp' AND conn_state IN ('S0', 'REJ', 'RSTOS0', 'RSTRH')"
_SYN_ACK = "proto = 'tcp' AND conn_state IN ('SF', 'S1', 'S2', 'S3', 'RSTO', 'RSTR', 'SH', 'SHR', 'OTH')"


@query(
    "a24_flow_windows",
    f"""SELECT a.w AS window_start, a.dst AS destination, flow_count, packet_count, byte_count,
      round(packet_count / {W}.0, 6) AS pkt_rate, round(byte_count / {W}.0, 6) AS byte_rate,
      unique_source_count, round(ent, 6) AS src_ip_entropy, tcp_flow_count, udp_flow_count, icmp_flow_count,
      tcp_syn_count, tcp_syn_ack_count, total_orig_ip_bytes, total_resp_ip_bytes, total_payload_bytes, states
    FROM (SELECT w, dst, count(*) AS flow_count, CAST(sum(orig_pkts + resp_pkts) AS BIGINT) AS packet_count,
        CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS byte_count,
        count(*) FILTER (proto = 'tcp') AS tcp_flow_count, count(*) FILTER (proto = 'udp') AS udp_flow_count,
        count(*) FILTER (proto = 'icmp') AS icmp_flow_count, count(*) FILTER ({_SYN}) AS tcp_syn_count,
        count(*) FILTER ({_SYN_ACK}) AS tcp_syn_ack_count,
        CAST(sum(orig_ip_bytes) AS BIGINT) AS total_orig_ip_bytes,
        CAST(sum(resp_ip_bytes) AS BIGINT) AS total_resp_ip_bytes,
        CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS total_payload_bytes
      FROM win GROUP BY w, dst) a JOIN win_entropy b ON a.w = b.w AND a.dst = b.dst
    JOIN (SELECT w, dst, string_agg(conn_state || '=' || n, ',' ORDER BY conn_state) AS states
      FROM (SELECT w, dst, conn_state, count(*) AS n FROM win GROUP BY ALL) GROUP BY ALL) c
      ON a.w = c.w AND a.dst = c.dst""",
    _X,
)
def flow_windows(spark, d):
    w = flow.flow_windows(conn_events(spark, d), W)
    states = F.array_join(
        F.array_sort(F.transform(F.map_entries("conn_state_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ","
    )
    return w.select(
        secs("window_start"),
        F.col("dst").alias("destination"),
        *("flow_count", "packet_count", "byte_count"),
        F.round("pkt_rate", 6).alias("pkt_rate"),
        F.round("byte_rate", 6).alias("byte_rate"),
        "unique_source_count",
        F.round("src_ip_entropy", 6).alias("src_ip_entropy"),
        *("tcp_flow_count", "udp_flow_count", "icmp_flow_count", "tcp_syn_count", "tcp_syn_ack_count"),
        *("total_orig_ip_bytes", "total_resp_ip_bytes", "total_payload_bytes"),
        states.alias("states"),
    )


@query(
    "a24_flow_windows_volume",
    f"""SELECT {sec('ts')} // 86400 * 86400 AS window_start, dst AS destination, count(*) AS flow_count,
      CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS byte_count, count(DISTINCT src) AS unique_source_count
    FROM conn_lines GROUP BY 1, 2""",
)
def flow_windows_volume(spark, d):
    w = flow.flow_windows(conn_lines(spark, d), 86_400)
    return w.select(secs("window_start"), F.col("dst").alias("destination"), "flow_count", "byte_count", "unique_source_count")


@query(
    "a24_source_counts",
    f"""SELECT w AS window_start, dst AS destination, src AS source, n AS flows FROM win_src""",
    _X,
)
def source_counts(spark, d):
    p = flow.flow_window_partials(conn_events(spark, d), W)
    return p.select(secs("window_start"), F.col("dst").alias("destination"), F.col("src").alias("source"), "flows")


@query(
    "a25_entropy",
    """SELECT dst, CAST(sum(n) AS BIGINT) AS observations, round(log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) / sum(n), 6) AS bits
    FROM (SELECT dst, src, count(*) AS n FROM conn_lines GROUP BY ALL) GROUP BY dst""",
)
def source_entropy(spark, d):
    e = entropy(conn_lines(spark, d), ["dst"], "src", "bits")
    return e.withColumn("bits", F.round("bits", 6))


@query(
    "p17_flow_features",
    """SELECT uid, round(duration, 8) AS duration, orig_bytes, resp_bytes, orig_ip_bytes + resp_ip_bytes AS total_bytes,
      orig_pkts + resp_pkts AS total_pkts,
      round(CASE WHEN duration > 0 THEN (orig_ip_bytes + resp_ip_bytes) / greatest(duration, 0.001) ELSE 0 END, 8) AS byte_rate,
      round(CASE WHEN duration > 0 THEN (orig_pkts + resp_pkts) / greatest(duration, 0.001) ELSE 0 END, 8) AS packet_rate,
      round(orig_ip_bytes / greatest(resp_ip_bytes, 1), 8) AS byte_ratio,
      round(orig_pkts / greatest(resp_pkts, 1), 8) AS packet_ratio, lower(proto) AS proto, upper(conn_state) AS conn_state,
      missed_bytes FROM conn_events""",
)
def flow_features(spark, d):
    f = flow.flow_features(conn_events(spark, d))
    rounded = [F.round(c, 8).alias(c) for c in ("duration", "byte_rate", "packet_rate", "byte_ratio", "packet_ratio")]
    return f.select("uid", "orig_bytes", "resp_bytes", "total_bytes", "total_pkts", "proto", "conn_state", "missed_bytes", *rounded)


@query(
    "p20_handshake_class",
    f"""SELECT conn_state, proto, count(*) FILTER ({_SYN}) AS syn_only, count(*) FILTER ({_SYN_ACK}) AS syn_ack
    FROM conn_events GROUP BY ALL""",
)
def handshake_class(spark, d):
    return conn_events(spark, d).groupBy("conn_state", "proto").agg(
        F.count_if(flow.is_syn_only()).alias("syn_only"), F.count_if(flow.is_syn_ack()).alias("syn_ack")
    )


@query(
    "a28_traffic_metrics",
    """SELECT count(*) AS connections, CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS total_bytes,
      CAST(sum(orig_pkts + resp_pkts) AS BIGINT) AS total_packets,
      (SELECT count(*) FROM (SELECT src FROM conn_events UNION SELECT dst FROM conn_events)) AS active_hosts,
      (SELECT count(*) FROM dns_pages) AS dns_queries, (SELECT count(*) FROM ssl_orders) AS tls_sessions
    FROM conn_events""",
)
def traffic_metrics(spark, d):
    return flow.traffic_totals(conn_events(spark, d), dns_pages(spark, d), ssl_orders(spark, d))


@query(
    "a28_protocol_counts",
    """SELECT upper(CASE WHEN service NOT IN ('', '-') THEN service ELSE proto END) AS protocol, count(*) AS connections
    FROM conn_events GROUP BY 1""",
)
def protocol_counts(spark, d):
    return flow.protocol_counts(conn_events(spark, d))


@query(
    "a28_byte_series",
    f"""SELECT {sec('ts')} // 10 * 10 AS bin_start, CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS bytes, count(*) AS connections
    FROM conn_events GROUP BY 1""",
)
def byte_series(spark, d):
    return flow.byte_series(conn_events(spark, d)).select(secs("bin_start"), "bytes", "connections")


@query(
    "a29_capture_stats",
    """SELECT count(*) AS connections, (SELECT count(*) FROM dns_pages) AS dns_records,
      (SELECT count(*) FROM ssl_orders) AS tls_records,
      (SELECT count(*) FROM (SELECT src FROM conn_lines UNION SELECT dst FROM conn_lines)) AS unique_hosts,
      CAST(sum(orig_pkts + resp_pkts) AS BIGINT) AS packets FROM conn_lines""",
)
def capture_stats(spark, d):
    return flow.capture_stats(conn_lines(spark, d), dns_pages(spark, d), ssl_orders(spark, d))


@query(
    "t03_top_talkers",
    """SELECT src AS host, count(*) AS connections, CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS bytes
    FROM conn_lines GROUP BY src ORDER BY connections DESC, host LIMIT 10""",
)
def top_sources(spark, d):
    return flow.top_talkers(conn_lines(spark, d), "src")


@query(
    "t03_top_destinations",
    """SELECT dst AS host, count(*) AS connections, CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS bytes
    FROM conn_lines GROUP BY dst ORDER BY connections DESC, host LIMIT 10""",
)
def top_destinations(spark, d):
    return flow.top_talkers(conn_lines(spark, d), "dst")


@query(
    "t04_recent_connections",
    f"""SELECT uid, {sec('ts')} AS ts, src, dst, dst_port FROM conn_events ORDER BY conn_events.ts DESC, uid LIMIT 20""",
)
def recent_connections(spark, d):
    return flow.recent_connections(conn_events(spark, d)).select("uid", secs("ts"), "src", "dst", "dst_port")


# ---- exfiltration ------------------------------------------------------------------

_E = {
    "out_conn": "SELECT * FROM conn_events WHERE src LIKE '10.%' AND dst NOT LIKE '10.%'",
    "exw": f"""SELECT {sec('ts')} // {W} * {W} AS w, src, dst, count(*) AS flow_count,
        CAST(sum(orig_bytes) AS BIGINT) AS outbound_bytes, CAST(sum(resp_bytes) AS BIGINT) AS inbound_bytes,
        CAST(sum(orig_pkts) AS BIGINT) AS orig_pkts, CAST(sum(resp_pkts) AS BIGINT) AS resp_pkts,
        sum(duration) AS duration_sum, sum(orig_bytes) / greatest(sum(resp_bytes), 1) AS byte_ratio
      FROM out_conn GROUP BY ALL""",
    "exb": """SELECT src, count(*) AS sample_count, round(avg(byte_ratio), 4) AS mean_ratio,
        round(stddev_pop(byte_ratio), 4) AS std_ratio, round(max(byte_ratio), 4) AS max_ratio,
        round(avg(outbound_bytes), 2) AS mean_volume, round(stddev_pop(outbound_bytes), 2) AS std_volume,
        max(outbound_bytes) AS max_volume FROM exw GROUP BY src""",
}


def _windows(spark, d):
    return exfil.exfil_windows(exfil.outbound_only(conn_events(spark, d), _EXFIL), W)


@query("p16_internal_to_external", "SELECT src, dst, count(*) AS n FROM out_conn GROUP BY ALL", _E)
def internal_to_external(spark, d):
    return exfil.outbound_only(conn_events(spark, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a26_exfil_windows",
    """SELECT w AS window_start, src, dst, flow_count, outbound_bytes, inbound_bytes, orig_pkts, resp_pkts,
      round(duration_sum, 4) AS duration_sum, round(byte_ratio, 6) AS byte_ratio FROM exw""",
    _E,
)
def exfil_windows(spark, d):
    return _windows(spark, d).select(
        secs("window_start"),
        *("src", "dst", "flow_count", "outbound_bytes", "inbound_bytes", "orig_pkts", "resp_pkts"),
        F.round("duration_sum", 4).alias("duration_sum"),
        F.round("byte_ratio", 6).alias("byte_ratio"),
    )


@query("a27_host_baseline", "SELECT * FROM exb", _E)
def host_baseline(spark, d):
    return exfil.host_baseline(_windows(spark, d))


_DEV = """SELECT w AS window_start, e.src, dst, round(byte_ratio, 8) AS byte_ratio, outbound_bytes, sample_count,
      CASE WHEN sample_count >= 3 THEN round((byte_ratio - mean_ratio) / greatest(std_ratio, 0.05), 4) ELSE 0 END AS baseline_deviation,
      CASE WHEN sample_count >= 3 THEN round(byte_ratio / greatest(mean_ratio, 0.01), 2) ELSE 1 END AS ratio_multiple,
      sample_count < 3 AS insufficient_baseline"""


@query("d05_exfil_deviation", _DEV + " FROM exw e JOIN exb b ON e.src = b.src", _E)
def exfil_deviation(spark, d):
    w = _windows(spark, d)
    return exfil.with_deviation(w, exfil.host_baseline(w)).select(
        secs("window_start"),
        *("src", "dst", "outbound_bytes", "sample_count", "insufficient_baseline"),
        F.round("byte_ratio", 8).alias("byte_ratio"),
        "baseline_deviation",
        "ratio_multiple",
    )


_DETECT = """SELECT w AS window_start, e.src, dst, outbound_bytes, inbound_bytes, round(byte_ratio, 8) AS byte_ratio,
      CASE WHEN outbound_bytes >= 10000000 OR byte_ratio >= 200 THEN 'critical'
        WHEN outbound_bytes >= 1000000 OR byte_ratio >= 50 THEN 'high' ELSE 'medium' END AS severity,
      round(least(0.95, greatest(0.5, 0.6 + 0.15 * log10(greatest(byte_ratio / 10, 1))
        + 0.05 * log10(greatest(outbound_bytes / 50000, 1)))), 2) AS confidence,
      'exfil_' || e.src || '_' || dst || '_' || w || '_' || (w + 3600) AS flow_id
    FROM exw e JOIN exb b ON e.src = b.src WHERE byte_ratio > 10 AND outbound_bytes >= {floor}"""


def _detected(spark, d, cfg):
    w = _windows(spark, d)
    return exfil.detect_exfil(w, exfil.host_baseline(w), cfg)


@query("d04_detect_exfil", _DETECT.format(floor=5000).replace("/ 50000", "/ 5000"), _E)
def detect_exfil(spark, d):
    return _detected(spark, d, ExfilConfig(window_seconds=W, volume_floor=5_000)).select(
        secs("window_start"),
        *("src", "dst", "outbound_bytes", "inbound_bytes", "severity", "confidence", "flow_id"),
        F.round("byte_ratio", 8).alias("byte_ratio"),
    )


@query(
    "a47_exfil_experiment_summary",
    """SELECT e.src AS dataset, CAST(sum(outbound_bytes) AS BIGINT) AS outbound_bytes, CAST(sum(inbound_bytes) AS BIGINT) AS inbound_bytes,
      max(outbound_bytes) AS max_window_volume, round(sum(outbound_bytes) / greatest(sum(inbound_bytes), 1), 8) AS byte_ratio,
      count(*) FILTER (byte_ratio > 10 AND outbound_bytes >= 5000) AS alerts FROM exw e GROUP BY e.src""",
    _E,
)
def exfil_experiment_summary(spark, d):
    w = _windows(spark, d).withColumn("dataset", F.col("src"))
    found = exfil.detect_exfil(w, exfil.host_baseline(w), ExfilConfig(volume_floor=5_000))
    return exfil.experiment_summary(w, found).withColumn("byte_ratio", F.round("byte_ratio", 8))


# ---- scans -------------------------------------------------------------------------

_S = {
    "scan_conn": """SELECT *, CASE WHEN history LIKE 'S%' AND conn_state = 'S0' AND contains(history, 'H') THEN true ELSE false END AS rev
      FROM (SELECT * REPLACE (CAST(orig_bytes % 97 + 1 AS INTEGER) AS dst_port,
              CASE WHEN event_type_view THEN '10.9.0.' || (orig_bytes % 61) ELSE dst END AS dst)
            FROM (SELECT *, conn_state = 'S0' AS event_type_view FROM conn_events))
      WHERE proto = 'tcp' AND conn_state IN ('S0', 'REJ')""",
    "roles": f"""SELECT uid, {sec('ts')} // 86400 * 86400 AS w, CASE WHEN rev THEN dst ELSE src END AS scanner,
        CASE WHEN rev THEN src ELSE dst END AS victim, CASE WHEN rev THEN src_port ELSE dst_port END AS probed_port, rev
      FROM scan_conn""",
}
_SCAN = ScanConfig(hosts=3, ports=4, window="1 day")


def _probing(spark, d):
    c = conn_events(spark, d)
    spread = F.col("conn_state") == "S0"
    return c.withColumn("dst_port", (F.col("orig_bytes") % 97 + 1).cast("int")).withColumn(
        "dst", F.when(spread, F.concat(F.lit("10.9.0."), (F.col("orig_bytes") % 61).cast("string"))).otherwise(F.col("dst"))
    )


@query("d10_scan_roles", "SELECT uid, scanner, victim, probed_port, rev AS reverse FROM roles", _S)
def scan_roles(spark, d):
    return scan.scan_roles(_probing(spark, d)).select("uid", "scanner", "victim", "probed_port", "reverse")


@query(
    "d08_port_scan",
    """SELECT w AS window_start, scanner, victim, count(DISTINCT probed_port) AS distinct_probes FROM roles
    GROUP BY ALL HAVING count(DISTINCT probed_port) >= 4""",
    _S,
)
def port_scan(spark, d):
    return scan.detect_port_scan(_probing(spark, d), _SCAN).withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "d09_address_scan",
    """SELECT w AS window_start, scanner, probed_port, count(DISTINCT victim) AS distinct_probes FROM roles
    GROUP BY ALL HAVING count(DISTINCT victim) >= 3""",
    _S,
)
def address_scan(spark, d):
    return scan.detect_address_scan(_probing(spark, d), _SCAN).withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "d11_scan_alerts",
    f"""SELECT 'scan_' || scanner || '_' || victim || '_' || w AS flow_id, scanner AS source, victim AS destination,
      'port_scan' AS subtype, 'high' AS severity, 0.95::DOUBLE AS confidence, CAST(count(DISTINCT probed_port) AS VARCHAR) AS scan_count
    FROM roles GROUP BY w, scanner, victim HAVING count(DISTINCT probed_port) >= 4""",
    _S,
)
def scan_alerts(spark, d):
    found = scan.detect_port_scan(_probing(spark, d), _SCAN)
    notices = found.select(
        F.lit("Scan::Port_Scan").alias("note"),
        F.unix_seconds("window_start").cast("double").alias("ts"),
        F.col("scanner").alias("src"),
        F.col("victim").alias("dst"),
        F.col("distinct_probes").alias("n"),
        F.lit(None).cast("int").alias("p"),
        F.lit("scanned").alias("msg"),
    )
    return scan.scan_findings(notices).select("flow_id", "source", "destination", "subtype", "severity", "confidence", "scan_count")
