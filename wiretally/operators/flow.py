"""Flow-level operators: windows, per-flow features, traffic reports.

``conn`` columns used here: uid, ts, src, src_port, dst, dst_port, proto, service,
duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, orig_ip_bytes, resp_ip_bytes,
conn_state, missed_bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.stats import entropy_from_counts

# Connection states by handshake outcome.
SYN_ONLY_STATES = ("S0", "REJ", "RSTOS0", "RSTRH")
SYN_ACK_STATES = ("SF", "S1", "S2", "S3", "RSTO", "RSTR", "SH", "SHR", "OTH")
CONN_STATES = SYN_ONLY_STATES + SYN_ACK_STATES


def is_syn_only() -> Column:
    return (F.col("proto") == "tcp") & F.col("conn_state").isin(*SYN_ONLY_STATES)


def is_syn_ack() -> Column:
    return (F.col("proto") == "tcp") & F.col("conn_state").isin(*SYN_ACK_STATES)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def flow_window_partials(conn: DataFrame, window_seconds: int) -> DataFrame:
    """One row per (window, destination, source): the mergeable part of a flow window.

    Grouping by source first spreads a flooded destination over its sources, is combined
    on the map side, and gives the source histogram as a relation instead of an
    unbounded map. The same plan runs as a stream in update or append mode.
    """
    states = [
        F.count_if(F.col("conn_state") == s).alias(f"state_{s}") for s in CONN_STATES
    ]
    return (
        conn.groupBy(F.window("ts", f"{window_seconds} seconds").alias("w"), "dst", "src")
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum(_zero("orig_pkts") + _zero("resp_pkts")).alias("packets"),
            F.sum(_zero("orig_ip_bytes")).alias("orig_ip_bytes"),
            F.sum(_zero("resp_ip_bytes")).alias("resp_ip_bytes"),
            F.sum(_zero("orig_bytes") + _zero("resp_bytes")).alias("payload_bytes"),
            F.count_if(F.col("proto") == "tcp").alias("tcp"),
            F.count_if(F.col("proto") == "udp").alias("udp"),
            F.count_if(F.col("proto") == "icmp").alias("icmp"),
            F.count_if(is_syn_only()).alias("syn"),
            F.count_if(is_syn_ack()).alias("syn_ack"),
            *states,
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*")
        .drop("w")
    )


def merge_flow_windows(partials: DataFrame, window_seconds: int) -> DataFrame:
    """Fold per-source partials into one row per (window, destination)."""
    width = F.lit(float(window_seconds))
    merged = partials.groupBy("window_start", "window_end", "dst").agg(
        F.sum("flows").alias("flow_count"),
        F.sum("packets").alias("packet_count"),
        F.sum(F.col("orig_ip_bytes") + F.col("resp_ip_bytes")).alias("byte_count"),
        F.count(F.lit(1)).alias("unique_source_count"),
        entropy_from_counts("flows").alias("src_ip_entropy"),
        F.min("src").alias("first_source"),
        F.sum("tcp").alias("tcp_flow_count"),
        F.sum("udp").alias("udp_flow_count"),
        F.sum("icmp").alias("icmp_flow_count"),
        F.sum("syn").alias("tcp_syn_count"),
        F.sum("syn_ack").alias("tcp_syn_ack_count"),
        F.sum("orig_ip_bytes").alias("total_orig_ip_bytes"),
        F.sum("resp_ip_bytes").alias("total_resp_ip_bytes"),
        F.sum("payload_bytes").alias("total_payload_bytes"),
        *[F.sum(f"state_{s}").alias(f"state_{s}") for s in CONN_STATES],
    )
    entries = F.array(
        *[F.struct(F.lit(s).alias("key"), F.col(f"state_{s}").alias("value")) for s in CONN_STATES]
    )
    return (
        merged.withColumn(
            "conn_state_counts", F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))
        )
        .withColumn("pkt_rate", F.col("packet_count") / width)
        .withColumn("byte_rate", F.col("byte_count") / width)
        .drop(*[f"state_{s}" for s in CONN_STATES])
    )


def flow_windows(conn: DataFrame, window_seconds: int = 5) -> DataFrame:
    """Tumbling windows per destination with rates, source entropy and protocol mix."""
    return merge_flow_windows(flow_window_partials(conn, window_seconds), window_seconds)


def flow_features(conn: DataFrame) -> DataFrame:
    """Canonical behavioural features of each flow, safe from NaN and zero division."""
    duration = F.col("duration")
    clean = F.when(
        duration.isNotNull() & ~F.isnan(duration) & (duration > 0) & (duration < float("inf")),
        duration,
    ).otherwise(F.lit(0.0))
    base = conn.select(
        "uid",
        "ts",
        "src",
        "dst",
        "dst_port",
        clean.alias("duration"),
        *[
            _zero(c).cast("bigint").alias(c)
            for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes")
        ],
        F.lower(F.coalesce("proto", F.lit("unknown"))).alias("proto"),
        F.upper(F.coalesce("conn_state", F.lit("unknown"))).alias("conn_state"),
        _zero("missed_bytes").cast("bigint").alias("missed_bytes"),
    )
    span = F.greatest(F.col("duration"), F.lit(0.001))
    rate = lambda total: F.when(F.col("duration") > 0, total / span).otherwise(F.lit(0.0))
    return (
        base.withColumn("total_bytes", F.col("orig_ip_bytes") + F.col("resp_ip_bytes"))
        .withColumn("total_pkts", F.col("orig_pkts") + F.col("resp_pkts"))
        .withColumn("byte_rate", rate(F.col("total_bytes")))
        .withColumn("packet_rate", rate(F.col("total_pkts")))
        .withColumn("byte_ratio", F.col("orig_ip_bytes") / F.greatest(F.col("resp_ip_bytes"), F.lit(1)))
        .withColumn("packet_ratio", F.col("orig_pkts") / F.greatest(F.col("resp_pkts"), F.lit(1)))
    )


# ---- traffic reports ---------------------------------------------------------------


def traffic_totals(conn: DataFrame, dns: DataFrame, tls: DataFrame) -> DataFrame:
    """One row: connections, bytes, packets, active hosts, DNS and TLS record totals."""
    totals = conn.agg(
        F.count(F.lit(1)).alias("connections"),
        F.sum(_zero("orig_bytes") + _zero("resp_bytes")).alias("total_bytes"),
        F.sum(_zero("orig_pkts") + _zero("resp_pkts")).alias("total_packets"),
    )
    return (
        totals.crossJoin(active_hosts(conn).agg(F.count(F.lit(1)).alias("active_hosts")))
        .crossJoin(dns.agg(F.count(F.lit(1)).alias("dns_queries")))
        .crossJoin(tls.agg(F.count(F.lit(1)).alias("tls_sessions")))
    )


def active_hosts(conn: DataFrame) -> DataFrame:
    """Distinct addresses seen as source or destination."""
    return conn.select(F.explode(F.array("src", "dst")).alias("host")).distinct()


def protocol_counts(conn: DataFrame) -> DataFrame:
    """Connections per service, or per transport protocol where no service is known."""
    label = F.when(
        F.col("service").isNotNull() & ~F.col("service").isin("", "-"), F.col("service")
    ).otherwise(F.col("proto"))
    return conn.groupBy(F.upper(label).alias("protocol")).agg(F.count(F.lit(1)).alias("connections"))


def byte_series(conn: DataFrame, bin_seconds: int = 10) -> DataFrame:
    """Bytes and connections per fixed time bin."""
    return conn.groupBy(F.window("ts", f"{bin_seconds} seconds").start.alias("bin_start")).agg(
        F.sum(_zero("orig_bytes") + _zero("resp_bytes")).alias("bytes"),
        F.count(F.lit(1)).alias("connections"),
    )


def capture_stats(conn: DataFrame, dns: DataFrame, tls: DataFrame) -> DataFrame:
    """One row per capture: connections, hosts, packets, DNS and TLS records."""
    return traffic_totals(conn, dns, tls).select(
        "connections",
        F.col("dns_queries").alias("dns_records"),
        F.col("tls_sessions").alias("tls_records"),
        F.col("active_hosts").alias("unique_hosts"),
        F.col("total_packets").alias("packets"),
    )


def top_talkers(conn: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k busiest sources or destinations; ties broken by address."""
    return (
        conn.groupBy(F.col(column).alias("host"))
        .agg(
            F.count(F.lit(1)).alias("connections"),
            F.sum(_zero("orig_bytes") + _zero("resp_bytes")).alias("bytes"),
        )
        .orderBy(F.desc("connections"), "host")
        .limit(k)
    )


def recent_connections(conn: DataFrame, k: int = 20) -> DataFrame:
    """The k newest connections; ties broken by uid."""
    return conn.orderBy(F.desc("ts"), "uid").limit(k)
