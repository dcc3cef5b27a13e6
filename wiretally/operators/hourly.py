"""Hourly aggregate tables.

Every table holds values that merge by sum, min, max or set union, so an hour can be
written once and re-aggregated over any range. Distributions (timestamps, sizes) are
tables of (key, value, count): a key has at most 3,600 distinct seconds per hour however
many connections it makes, and no array ever grows with the traffic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions.domains import is_exportable_domain, suffixes

_PAIR = ["src", "src_nuid", "dst", "dst_nuid", "hash", "src_local", "dst_local"]


def hour(ts: str = "ts") -> Column:
    return F.date_trunc("hour", ts)


def since(df: DataFrame, min_ts: Column, column: str = "hour") -> DataFrame:
    """Rows from the hour of ``min_ts`` on; prunes partitions of hourly tables."""
    return df.filter(F.col(column) >= F.date_trunc("hour", min_ts))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def value_list(df: DataFrame, keys: list[str], value: str, alias: str, cap: int | None = None) -> DataFrame:
    """The distinct values per key, sorted; for display the first ``cap`` of them.

    A cap's rank limit runs before and after the shuffle, so no more than ``cap`` values per
    key and task are ever gathered.
    """
    values = df.select(*keys, value).distinct()
    if cap is not None:
        first = Window.partitionBy(*keys).orderBy(value)
        values = values.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= cap)
    return (
        values.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(value)).alias(alias))
    )


def _traffic(where: Column) -> list[Column]:
    total = lambda e, name: F.coalesce(F.sum(F.when(where, e)), F.lit(0)).alias(name)
    both = F.col("src_ip_bytes") + F.col("dst_ip_bytes")
    return [
        total(F.col("src_ip_bytes"), "total_src_ip_bytes"),
        total(F.col("dst_ip_bytes"), "total_dst_ip_bytes"),
        total(F.col("src_bytes"), "total_src_bytes"),
        total(F.col("dst_bytes"), "total_dst_bytes"),
        total(both, "total_ip_bytes"),
        total(F.col("src_packets"), "total_src_packets"),
        total(F.col("dst_packets"), "total_dst_packets"),
        F.coalesce(F.sum(F.when(where, F.col("duration"))), F.lit(0.0)).alias("total_duration"),
    ]


def agg_uconn(conn: DataFrame) -> DataFrame:
    """Address pairs per hour. Rows added for requests without a host only count as such."""
    real = ~F.col("missing_host_header")
    return conn.groupBy(hour().alias("hour"), *_PAIR).agg(
        F.count_if(real).alias("count"),
        F.count_if(~real).alias("missing_host_count"),
        F.count_distinct("ts").alias("unique_ts_count"),
        *_traffic(real),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def pair_seconds(conn: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Connections per key and second."""
    rows = conn.filter(~F.col("missing_host_header")) if "missing_host_header" in conn.columns else conn
    return rows.groupBy(hour().alias("hour"), *(keys or ["hash"]), "ts").agg(
        F.count(F.lit(1)).alias("n")
    )


def pair_sizes(conn: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Connections per key and source byte count."""
    rows = conn.filter(~F.col("missing_host_header")) if "missing_host_header" in conn.columns else conn
    return rows.groupBy(hour().alias("hour"), *(keys or ["hash"]), "src_ip_bytes").agg(
        F.count(F.lit(1)).alias("n")
    )


def agg_usni_ssl(ssl: DataFrame) -> DataFrame:
    """Source and server name per hour and server, from TLS."""
    return ssl.groupBy(hour().alias("hour"), *_PAIR, F.col("server_name").alias("fqdn")).agg(
        F.lit(False).alias("http"),
        F.lit(False).alias("proxy"),
        F.count(F.lit(1)).alias("count"),
        F.lit(0).cast("bigint").alias("proxy_count"),
        F.count_distinct("ts").alias("unique_ts_count"),
        *_traffic(F.lit(True)),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def hosted_requests(http: DataFrame) -> DataFrame:
    """Requests that stand for their connection and name a host."""
    return http.filter(~F.col("multi_request") & (F.col("host") != ""))


def agg_usni_http(http: DataFrame) -> DataFrame:
    """Source and host per hour and server, from HTTP; CONNECT marks a proxy."""
    proxy = (F.col("method") == "CONNECT").alias("proxy")
    return (
        hosted_requests(http)
        .groupBy(hour().alias("hour"), *_PAIR, F.col("host").alias("fqdn"), proxy)
        .agg(
            F.lit(True).alias("http"),
            F.count(F.lit(1)).alias("count"),
            F.count_if(F.col("method") == "CONNECT").alias("proxy_count"),
            F.count_distinct("ts").alias("unique_ts_count"),
            *_traffic(F.lit(True)),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )


def agg_udns(dns: DataFrame) -> DataFrame:
    """Queries per hour, name and endpoints."""
    keys = ["tld", F.col("query").alias("fqdn"), *_PAIR, "src_port", "dst_port"]
    return dns.groupBy(hour().alias("hour"), *keys).agg(
        F.count(F.lit(1)).alias("visits"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def agg_pdns(resolved: DataFrame) -> DataFrame:
    """Resolved addresses per day and name."""
    keys = ["tld", F.col("query").alias("fqdn"), "resolved_ip", "src", "src_nuid", "dst", "dst_nuid", "hash"]
    return resolved.groupBy(F.date_trunc("day", "ts").alias("day"), *keys).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def explode_names(udns: DataFrame) -> DataFrame:
    """Hourly visits per (suffix, full name), for every suffix of the name.

    Names are aggregated before they are exploded; the table is the exact subdomain set
    in relational form and merges across hours by distinct.
    """
    return (
        udns.filter(is_exportable_domain("tld"))
        .groupBy("hour", "tld", "fqdn")
        .agg(F.sum("visits").alias("visits"))
        .withColumn("suffix", F.explode(suffixes("fqdn", "tld")))
    )


def agg_exploded_dns(udns: DataFrame) -> DataFrame:
    """Distinct names and visits per hour and suffix."""
    return (
        explode_names(udns)
        .groupBy("hour", "tld", "suffix")
        .agg(F.count(F.lit(1)).alias("subdomains"), F.sum("visits").alias("visits"))
    )


def agg_histogram15(conn: DataFrame, http: DataFrame, ssl: DataFrame) -> DataFrame:
    """Bytes and connections per key and quarter hour."""
    frames = [
        conn.select("hash", "ts", "src_ip_bytes"),
        http.filter(F.col("host") != "").select("hash", "ts", "src_ip_bytes"),
        ssl.select("hash", "ts", "src_ip_bytes"),
    ]
    bucket = F.window("ts", "15 minutes").start.alias("bucket")
    return union_all(frames).groupBy("hash", bucket).agg(
        F.sum("src_ip_bytes").alias("src_ip_bytes"), F.count(F.lit(1)).alias("count")
    )


def agg_tls_proto(ssl: DataFrame) -> DataFrame:
    keys = ["hash", "ja3", "ja3s", "version", "validation_status"]
    return ssl.groupBy(hour().alias("hour"), *keys).agg(F.count(F.lit(1)).alias("count"))


def agg_http_proto(http: DataFrame) -> DataFrame:
    """Requests per client string, method, referrer and uri, with the MIME types served."""
    keys = ["hash", "user_agent", "method", "referrer", "uri"]
    return http.groupBy(hour().alias("hour"), *keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("dst_mime_types")))).alias("dst_mime_types"),
    )


def signature_uses(http: DataFrame, ssl: DataFrame, conn: DataFrame) -> DataFrame:
    """Distinct (source, signature, destination or name) triples from the three logs."""
    web = http.filter((F.col("user_agent") != "") & (F.col("host") != "")).select(
        hour().alias("hour"),
        "src",
        "src_nuid",
        F.col("host").alias("fqdn"),
        F.col("user_agent").alias("signature"),
        F.lit(False).alias("is_ja3"),
        F.col("dst").alias("used_dst"),
    )
    tls = ssl.filter(F.col("ja3") != "").select(
        hour().alias("hour"),
        "src",
        "src_nuid",
        F.col("server_name").alias("fqdn"),
        F.col("ja3").alias("signature"),
        F.lit(True).alias("is_ja3"),
        F.col("dst").alias("used_dst"),
    )
    bare = conn.filter(F.col("missing_host_header") & (F.col("missing_host_useragent") != "")).select(
        hour().alias("hour"),
        "src",
        "src_nuid",
        "dst",
        "dst_nuid",
        F.col("missing_host_useragent").alias("signature"),
        F.lit(False).alias("is_ja3"),
        F.when(F.col("src_local"), F.col("dst")).otherwise(F.col("src")).alias("used_dst"),
    )
    return (
        union_all([web, tls, bare])
        .select("hour", "src", "src_nuid", "dst", "dst_nuid", "fqdn", "signature", "is_ja3", "used_dst")
        .fillna("", ["dst", "dst_nuid", "fqdn"])
        .distinct()
    )


def agg_signatures(http: DataFrame, ssl: DataFrame, conn: DataFrame) -> DataFrame:
    """Signatures per hour and pair with the number of destinations they were used for."""
    keys = ["hour", "src", "src_nuid", "dst", "dst_nuid", "fqdn", "signature", "is_ja3"]
    return signature_uses(http, ssl, conn).groupBy(*keys).agg(
        F.count_distinct("used_dst").alias("times_used_dst"),
        F.max((F.col("fqdn") != "").cast("int")).alias("times_used_fqdn"),
    )


def agg_port_info(conn: DataFrame, http: DataFrame, ssl: DataFrame) -> DataFrame:
    """Ports and services per key, with bytes each way."""
    icmp = F.col("proto") == "icmp"
    sums = [F.sum("src_ip_bytes").alias("bytes_sent"), F.sum("dst_ip_bytes").alias("bytes_received")]
    shared = ["hash", "src", "src_nuid", "dst_port", "proto", "service", "conn_state"]
    by_ip = (
        conn.filter(~F.col("missing_host_header"))
        .groupBy(
            hour().alias("hour"),
            *shared,
            "dst",
            "dst_nuid",
            F.when(icmp, F.col("src_port")).otherwise(0).alias("icmp_type"),
            F.when(icmp, F.col("dst_port")).otherwise(0).alias("icmp_code"),
        )
        .agg(F.count(F.lit(1)).alias("count"), *sums)
    )
    by_host = http.groupBy(hour().alias("hour"), *shared, F.col("host").alias("fqdn")).agg(
        F.count_if(~F.col("multi_request")).alias("count"), *sums
    )
    by_sni = ssl.groupBy(hour().alias("hour"), *shared, F.col("server_name").alias("fqdn")).agg(
        F.count(F.lit(1)).alias("count"), *sums
    )
    return (
        union_all([by_ip, by_host, by_sni])
        .fillna("", ["dst", "dst_nuid", "fqdn"])
        .fillna(0, ["icmp_type", "icmp_code"])
    )


def path_extension(uri: Column) -> Column:
    """Extension of the last path segment, '' when there is none."""
    path = F.regexp_replace(F.regexp_replace(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(~last.contains(".") | path.endswith("."), F.lit("")).otherwise(
        F.element_at(F.split(last, r"\."), -1)
    )


def mime_mismatch(http: DataFrame, valid_mime: DataFrame) -> DataFrame:
    """Requests whose MIME type is known but not valid for the extension asked for.

    A type is known when it is listed at all; a mismatch is the absence of the exact
    (type, extension) pair. Two equi joins, no list of extensions is gathered; the configured
    list of pairs goes to the requests, which are not dealt by type.
    """
    served = (
        http.filter(F.col("uri") != "/")
        .withColumn("mime_type", F.explode("dst_mime_types"))
        .withColumn("extension", path_extension(F.col("uri")))
    )
    pairs = valid_mime.select("mime_type", "extension").distinct()
    return served.join(F.broadcast(pairs.select("mime_type").distinct()), "mime_type", "left_semi").join(
        F.broadcast(pairs), ["mime_type", "extension"], "left_anti"
    )


def agg_mime_uris(http: DataFrame, valid_mime: DataFrame) -> DataFrame:
    keys = ["hash", "uri", "extension", "mime_type"]
    return (
        mime_mismatch(http, valid_mime)
        .groupBy(hour().alias("hour"), *keys)
        .agg(F.count(F.lit(1)).alias("mismatch_count"))
    )


def count_mime_mismatches(http: DataFrame, valid_mime: DataFrame) -> DataFrame:
    """Mismatches per key: the sums of :func:`agg_mime_uris`, without its rows per hour and URI."""
    return mime_mismatch(http, valid_mime).groupBy("hash").agg(F.count(F.lit(1)).alias("mismatch_count"))


def agg_first_seen(
    conns: list[DataFrame], names: list[tuple[DataFrame, str]], previous: DataFrame | None = None
) -> DataFrame:
    """First and last sight of every external address and every name.

    ``conns`` are connection tables, ``names`` (table, name column) pairs; ``previous`` is
    the table of earlier imports, merged in.
    """
    external = F.when(F.col("src_local"), F.col("dst")).otherwise(F.col("src"))
    span = lambda df: df.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    frames = [
        span(c.groupBy(external.alias("ip"))).withColumn("fqdn", F.lit("")) for c in conns
    ] + [
        span(df.filter(F.col(col) != "").groupBy(F.col(col).alias("fqdn"))).withColumn("ip", F.lit(""))
        for df, col in names
    ]
    if previous is not None:
        frames.append(previous.select("ip", "fqdn", "first_seen", "last_seen"))
    return union_all(frames).groupBy("ip", "fqdn").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def agg_min_max(
    conn: DataFrame, http: DataFrame, open_conn: DataFrame, open_http: DataFrame, udns: DataFrame
) -> DataFrame:
    """Covered time per source of it; only closed connections count for beaconing."""
    tunnel = F.col("method") == "CONNECT"
    span = lambda df, col, beacon: df.agg(
        F.min(col).alias("min_ts"), F.max(col).alias("max_ts")
    ).withColumn("beacon", F.lit(beacon))
    return (
        union_all(
            [
                span(conn, "ts", True),
                span(http.filter(tunnel), "ts", True),
                span(open_conn, "ts", False),
                span(open_http.filter(tunnel), "ts", False),
                span(udns, "hour", False),
            ]
        )
        .filter(F.col("min_ts").isNotNull())
        .groupBy("beacon")
        .agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    )


def analysis_range(min_max: DataFrame, beacon_only: bool = False) -> DataFrame:
    """One row: the last 24 hours of the covered time."""
    rows = min_max.filter("beacon") if beacon_only else min_max
    return rows.agg(F.min("min_ts").alias("_min"), F.max("max_ts").alias("max_ts")).select(
        F.greatest("_min", F.col("max_ts") - F.expr("INTERVAL 24 HOURS")).alias("min_ts"), "max_ts"
    )


def use_current_time(range_row: DataFrame, rolling: bool, now: Column | None = None) -> DataFrame:
    """Whether ages are measured from now: rolling data no older than 24 hours."""
    now = F.current_timestamp() if now is None else now
    fresh = F.col("max_ts") >= now - F.expr("INTERVAL 24 HOURS")
    return range_row.withColumn("use_current_time", F.lit(rolling) & fresh)


def import_keys(named: dict[str, DataFrame]) -> DataFrame:
    """Distinct (kind, key, uid) of everything this import touched."""
    return union_all(
        [
            df.select(F.lit(kind).alias("conn_type"), "hash", "zeek_uid").distinct()
            for kind, df in named.items()
        ]
    )


def import_domains(dns: DataFrame) -> DataFrame:
    return dns.groupBy("tld").agg(F.count(F.lit(1)).alias("queries"))
