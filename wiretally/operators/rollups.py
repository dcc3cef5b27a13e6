"""Roll-ups over hourly tables: pair totals, prevalence, network size, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.domains import registrable_domain
from wiretally.functions.net import port_label
from wiretally.operators.hourly import union_all, value_list


# ---- network size and prevalence ---------------------------------------------------


def internal_hosts(tables: list[DataFrame]) -> DataFrame:
    """Distinct internal addresses on either side of the given tables."""
    sides = []
    for df in tables:
        sides.append(df.filter("src_local").select(F.col("src").alias("host")))
        sides.append(df.filter("dst_local").select(F.col("dst").alias("host")))
    return union_all(sides).distinct()


def network_size(tables: list[DataFrame]) -> DataFrame:
    return internal_hosts(tables).agg(F.count(F.lit(1)).alias("network_size"))


def prevalence_ip(pairs: list[DataFrame]) -> DataFrame:
    """Distinct internal peers per external address."""
    peers = [
        df.select(
            F.when(F.col("src_local"), F.col("dst")).otherwise(F.col("src")).alias("ip"),
            F.when(F.col("src_local"), F.col("src")).otherwise(F.col("dst")).alias("peer"),
        )
        for df in pairs
    ]
    return union_all(peers).distinct().groupBy("ip").agg(F.count(F.lit(1)).alias("prevalence_total"))


def _named_peers(named: list[tuple[DataFrame, Column]], alias: str) -> DataFrame:
    sides = []
    for df, name in named:
        sides.append(df.filter("src_local").select(name.alias(alias), F.col("src").alias("peer")))
        sides.append(df.filter("dst_local").select(name.alias(alias), F.col("dst").alias("peer")))
    return union_all(sides).distinct().groupBy(alias).agg(F.count(F.lit(1)).alias("prevalence_total"))


def prevalence_fqdn(named: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct internal hosts per name; ``named`` are (table, name column) pairs."""
    return _named_peers([(df, F.col(c)) for df, c in named], "fqdn")


def prevalence_tld(named: list[tuple[DataFrame, str]], udns: DataFrame) -> DataFrame:
    """Distinct internal hosts per registrable domain."""
    pairs = [(df, registrable_domain(c)) for df, c in named] + [(udns, F.col("tld"))]
    return _named_peers(pairs, "tld")


# ---- roll-ups ----------------------------------------------------------------------


def rollup_ip(uconn: DataFrame, open_conn: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Address pairs over the range: closed and open connections united by name.

    ``keys`` restricts to the pairs of :func:`ip_only_keys`; the semi join runs below the
    aggregation.
    """
    pair = ["hash", "src", "src_nuid", "dst", "dst_nuid", "src_local", "dst_local"]
    if keys is not None:
        uconn = uconn.join(keys, "hash", "left_semi")
        open_conn = open_conn.join(keys, "hash", "left_semi")
    closed = uconn.groupBy(*pair).agg(
        F.sum("missing_host_count").alias("missing_host_count"),
        F.sum("count").alias("count"),
        F.sum("total_duration").alias("closed_duration"),
        F.sum("unique_ts_count").alias("ts_unique"),
        F.sum("total_ip_bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    opened = open_conn.groupBy(*pair).agg(
        F.count_if("missing_host_header").alias("missing_host_count"),
        F.count(F.lit(1)).alias("open_count"),
        F.sum("duration").alias("open_duration"),
        F.sum(F.col("src_ip_bytes") + F.col("dst_ip_bytes")).alias("total_bytes"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        union_all([closed, opened])
        .groupBy(*pair)
        .agg(
            total("missing_host_count").alias("missing_host_count"),
            total("count").alias("count"),
            total("open_count").alias("open_count"),
            (total("closed_duration") + total("open_duration")).cast("double").alias("total_duration"),
            total("open_duration").cast("double").alias("open_total_duration"),
            F.coalesce(F.max("ts_unique"), F.lit(0)).alias("ts_unique"),
            total("total_bytes").alias("total_bytes"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
        .withColumn("proxy_count", F.lit(0).cast("bigint"))
        .withColumn(
            "target_ip",
            F.when(F.col("src_local"), F.col("dst")).when(F.col("dst_local"), F.col("src")).otherwise(F.col("dst")),
        )
    )


def sni_seconds(seconds: DataFrame) -> DataFrame:
    """Distinct seconds per server-name key: the larger of direct and proxied traffic."""
    per_side = seconds.groupBy("hash", "proxy").agg(F.count_distinct("ts").alias("_u"))
    return per_side.groupBy("hash").agg(F.max("_u").alias("ts_unique"))


def rollup_sni(
    usni: DataFrame, seconds: DataFrame, open_http: DataFrame, open_ssl: DataFrame, cap: int | None = None
) -> DataFrame:
    """Source and server name over the range, from closed and open HTTP and TLS.

    ``seconds``: hash, proxy, ts rows of the closed connections; ``cap``: entries kept in the
    lists of addresses (default: all).
    """
    pair = ["hash", "src", "src_nuid", "fqdn"]
    closed = usni.select(
        *pair,
        "count",
        "proxy_count",
        F.lit(0).cast("bigint").alias("open_count"),
        F.col("total_duration").alias("closed_duration"),
        F.lit(0.0).alias("open_duration"),
        F.col("total_ip_bytes").alias("bytes"),
        "first_seen",
        "last_seen",
        "dst",
        "proxy",
    )
    opened = lambda df, name, proxy, counted: df.select(
        *pair[:3],
        F.col(name).alias("fqdn"),
        F.lit(0).cast("bigint").alias("count"),
        proxy.cast("bigint").alias("proxy_count"),
        counted.cast("bigint").alias("open_count"),
        F.lit(0.0).alias("closed_duration"),
        F.col("duration").alias("open_duration"),
        (F.col("src_ip_bytes") + F.col("dst_ip_bytes")).alias("bytes"),
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
        "dst",
        proxy.alias("proxy"),
    )
    rows = union_all(
        [
            closed,
            opened(open_http.filter(F.col("host") != ""), "host", F.col("method") == "CONNECT", ~F.col("multi_request")),
            opened(open_ssl, "server_name", F.lit(False), F.lit(True)),
        ]
    )
    totals = rows.groupBy(*pair).agg(
        F.sum("count").alias("count"),
        F.sum("open_count").alias("open_count"),
        F.sum("proxy_count").alias("proxy_count"),
        (F.sum("closed_duration") + F.sum("open_duration")).alias("total_duration"),
        F.sum("open_duration").alias("open_total_duration"),
        F.sum("bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    servers = value_list(rows.filter(~F.col("proxy")), ["hash"], "dst", "server_ips", cap)
    proxies = value_list(rows.filter("proxy"), ["hash"], "dst", "proxy_ips", cap)
    empty = F.array().cast("array<string>")
    return (
        totals.join(sni_seconds(seconds), "hash", "left")
        .join(servers, "hash", "left")
        .join(proxies, "hash", "left")
        .withColumn("ts_unique", F.coalesce("ts_unique", F.lit(0)))
        .withColumn("server_ips", F.coalesce("server_ips", empty))
        .withColumn("proxy_ips", F.coalesce("proxy_ips", empty))
    )


def rollup_dns(exploded: DataFrame, udns: DataFrame, min_subdomains: int) -> DataFrame:
    """Registrable domains with many distinct names, and when they were seen.

    ``exploded`` is :func:`explode_names`; names are made distinct before counting.
    """
    names = (
        exploded.select("tld", "fqdn")
        .distinct()
        .groupBy("tld")
        .agg(F.count(F.lit(1)).alias("subdomain_count"))
        .filter(F.col("subdomain_count") >= min_subdomains)
    )
    seen = udns.groupBy("tld").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return names.join(seen, "tld")


# ---- attachments: left joins that cannot multiply rows -----------------------------


def attach_intel(df: DataFrame, intel: DataFrame, column: str, entry: str, alias: str = "on_threat_intel") -> DataFrame:
    """Flag rows whose value is listed; the list is made distinct first."""
    listed = intel.filter(F.coalesce(F.col(entry), F.lit("")) != "").select(F.col(entry).alias(column)).distinct()
    return df.join(listed.withColumn(alias, F.lit(True)), column, "left").withColumn(
        alias, F.coalesce(alias, F.lit(False))
    )


def attach_prevalence(df: DataFrame, counts: DataFrame, column: str, key: str, size: DataFrame) -> DataFrame:
    """Peers seen and their share of the network; no peers counts as zero."""
    return (
        df.join(counts.withColumnRenamed(key, column), column, "left")
        .crossJoin(F.broadcast(size))  # one row
        .withColumn("prevalence_total", F.coalesce("prevalence_total", F.lit(0)))
        .withColumn(
            "prevalence",
            F.coalesce(F.try_divide(F.col("prevalence_total"), F.col("network_size")), F.lit(0.0)),
        )
    )


def attach_first_seen(df: DataFrame, history: DataFrame, column: str, key: str, use_history: bool) -> DataFrame:
    """Earliest sight ever (rolling and fresh data) or in this range."""
    if not use_history:
        return df.withColumn("first_seen_historical", F.col("first_seen"))
    known = (
        history.filter(F.col(key) != "")
        .join(df.select(F.col(column).alias(key)).distinct(), key, "left_semi")
        .groupBy(F.col(key).alias(column))
        .agg(F.min("first_seen").alias("first_seen_historical"))
    )
    return df.join(known, column, "left").withColumn(
        "first_seen_historical", F.coalesce("first_seen_historical", "first_seen")
    )


def port_labels(port_info: DataFrame, open_logs: list[DataFrame], cap: int | None = None) -> DataFrame:
    """Distinct port labels per key as a sorted list; for display of at most ``cap``."""
    closed = port_info.select(
        "hash", port_label("proto", "icmp_type", F.when(F.col("proto") == "icmp", F.col("icmp_code")).otherwise(F.col("dst_port")), "service").alias("label")
    )
    opened = [
        df.select("hash", port_label("proto", "src_port", "dst_port", "service").alias("label"))
        for df in open_logs
    ]
    return value_list(union_all([closed, *opened]), ["hash"], "label", "port_proto_service", cap)


def attach_ports(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "hash", "left").withColumn(
        "port_proto_service",
        F.coalesce("port_proto_service", F.array().cast("array<string>")),
    )


# ---- direct connections to suspicious domains --------------------------------------


def direct_connections(suspicious: DataFrame, pdns: DataFrame, uconn: DataFrame) -> DataFrame:
    """Distinct (domain, source) where the source contacted an address of the domain."""
    addresses = (
        pdns.join(suspicious.select("tld"), "tld", "left_semi").select("tld", "resolved_ip").distinct()
    )
    contacts = uconn.select("src", F.col("dst").alias("resolved_ip")).distinct()
    return contacts.join(addresses, "resolved_ip").select("tld", "src").distinct()


def no_direct_conn_flag(suspicious: DataFrame, direct: DataFrame, udns: DataFrame) -> DataFrame:
    """Per contacted domain: True when only hosts that queried it also contacted it, or
    when nobody queried it."""
    queried = (
        udns.join(suspicious.select("tld"), "tld", "left_semi")
        .select("tld", "src")
        .distinct()
        .withColumn("asked", F.lit(True))
    )
    askers = queried.groupBy("tld").agg(F.count(F.lit(1)).alias("askers"))
    outsiders = (
        direct.join(queried, ["tld", "src"], "left")
        .groupBy("tld")
        .agg(F.max(F.col("asked").isNull()).alias("has_outsider"))
    )
    return outsiders.join(askers, "tld", "left").select(
        "tld",
        (F.col("askers").isNull() | ~F.col("has_outsider")).alias("no_direct_conn"),
    )
