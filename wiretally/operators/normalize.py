"""From raw log records to filtered, keyed entries.

Raw columns follow the log format with dots replaced: ts (timestamp), uid, src, src_port,
dst, dst_port, plus the fields of each log type; ``agent_uuid`` names the sensor, if any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.config import FilterConfig
from wiretally.functions.domains import filter_domain, registrable_domain
from wiretally.functions.net import NON_PUBLIC, conn_key, network_id, with_addresses, with_membership

# ---- pair filters: True means the pair is dropped ----------------------------------
# ``src`` and ``dst`` are membership structs, see :func:`membership_lists`.


def membership_lists(cfg: FilterConfig) -> dict[str, tuple[str, ...]]:
    return {
        "always": cfg.always_subnets,
        "never": cfg.never_subnets,
        "internal": cfg.internal_subnets,
        "private": NON_PUBLIC,
    }


def filter_conn_pair(src: Column, dst: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    """Keeps traffic that crosses the border of the internal network."""
    always, never = src["always"] | dst["always"], src["never"] | dst["never"]
    if not cfg.internal_subnets:
        return F.when(always, False).otherwise(never)
    same_side = src["internal"] == dst["internal"]
    inbound = F.lit(cfg.drop_external_to_internal) & ~src["internal"] & dst["internal"]
    return F.when(always, False).otherwise(never | same_side | inbound)


def filter_conn_pair_http(src: Column, dst: Column) -> Column:
    """Like the pair filter but keeps internal pairs, which may lead to a proxy."""
    always, never = src["always"] | dst["always"], src["never"] | dst["never"]
    return F.when(always, False).otherwise(never | (~src["internal"] & ~dst["internal"]))


def filter_dns_pair(src: Column, dst: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    """Keeps internal pairs too, because resolvers are often internal."""
    always, never = src["always"] | dst["always"], src["never"] | dst["never"]
    if not cfg.internal_subnets:
        return F.when(always, False).otherwise(never)
    outside = ~src["internal"] & ~dst["internal"]
    inbound = F.lit(cfg.drop_external_to_internal) & ~src["internal"] & dst["internal"]
    return F.when(always, False).otherwise(never | outside | inbound)


def filter_ip(ip: Column) -> Column:
    return ~ip["always"] & ip["never"]


def filter_sni_src(src: Column) -> Column:
    return ~src["internal"]


# ---- entries -----------------------------------------------------------------------


def _endpoints(raw: DataFrame, cfg: FilterConfig) -> DataFrame:
    """Parse both addresses, drop rows where one is invalid, add locality and network."""
    agent = F.col("agent_uuid") if "agent_uuid" in raw.columns else F.lit(None).cast("string")
    parsed = with_addresses(raw, {"src_hex": "src", "dst_hex": "dst"}, canonical=True).filter(
        F.col("src_hex").isNotNull() & F.col("dst_hex").isNotNull()
    )
    return (
        with_membership(parsed, {"src_in": "src_hex", "dst_in": "dst_hex"}, membership_lists(cfg))
        .withColumn("src_nuid", network_id(F.col("src_in.private"), agent))
        .withColumn("dst_nuid", network_id(F.col("dst_in.private"), agent))
        .withColumn("src_local", F.col("src_in.internal"))
        .withColumn("dst_local", F.col("dst_in.internal"))
        .withColumn("ts", F.date_trunc("second", "ts"))
        .withColumn("zeek_uid", conn_key("uid"))
        .drop("src_hex", "dst_hex")
    )


def normalize_conn(raw: DataFrame, cfg: FilterConfig = FilterConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Connection entries. ``filtered`` rows survive only so that proxies can link.

    ``keep`` names further columns of ``raw`` to pass on.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    icmp = F.col("proto") == "icmp"
    entries = _endpoints(raw, cfg)
    return (
        entries.filter(~filter_conn_pair_http(F.col("src_in"), F.col("dst_in")))
        .withColumn("filtered", filter_conn_pair(F.col("src_in"), F.col("dst_in"), cfg))
        .select(
            "ts",
            "zeek_uid",
            conn_key("src", "src_nuid", "dst", "dst_nuid").alias("hash"),
            "filtered",
            "src",
            "dst",
            "src_nuid",
            "dst_nuid",
            "src_port",
            "dst_port",
            "src_local",
            "dst_local",
            "proto",
            F.coalesce("service", F.lit("")).alias("service"),
            F.coalesce("conn_state", F.lit("")).alias("conn_state"),
            F.coalesce("duration", F.lit(0.0)).alias("duration"),
            F.when(icmp, F.col("src_port")).otherwise(-1).alias("icmp_type"),
            F.when(icmp, F.col("dst_port")).otherwise(-1).alias("icmp_code"),
            zero("orig_bytes").alias("src_bytes"),
            zero("resp_bytes").alias("dst_bytes"),
            zero("orig_ip_bytes").alias("src_ip_bytes"),
            zero("resp_ip_bytes").alias("dst_ip_bytes"),
            zero("orig_pkts").alias("src_packets"),
            zero("resp_pkts").alias("dst_packets"),
            F.lit(False).alias("missing_host_header"),
            F.lit("").alias("missing_host_useragent"),
            *keep,
        )
    )


def unfiltered(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("filtered")).drop("filtered")


def normalize_dns(raw: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """DNS entries: named queries with a dot, after domain and pair filters."""
    query = F.col("query")
    entries = _endpoints(raw.filter((query != "") & query.contains(".")), cfg)
    dropped = filter_domain("query", cfg.always_domains, cfg.never_domains) | filter_dns_pair(
        F.col("src_in"), F.col("dst_in"), cfg
    )
    return (
        entries.filter(~dropped)
        .withColumn("hash", conn_key("src", "dst", "query"))
        .withColumn("tld", registrable_domain("query"))
        .drop("src_in", "dst_in")
    )


def normalize_http(raw: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """HTTP entries. For CONNECT the destination is a proxy, not the end point, so the
    source and the named host are filtered instead of the address pair."""
    hosts = with_addresses(raw.withColumn("host", F.coalesce("host", F.lit(""))), {"_host_hex": "host"})
    entries = with_membership(_endpoints(hosts, cfg), {"_host_in": "_host_hex"}, membership_lists(cfg))
    src, dst, host = F.col("src_in"), F.col("dst_in"), F.col("_host_in")
    denied = filter_domain("host", cfg.always_domains, cfg.never_domains)
    proxy_drop = filter_ip(src) | (
        F.col("_host_hex").isNotNull() & F.col("dst_local") & filter_conn_pair(src, host, cfg)
    )
    direct_drop = filter_conn_pair(src, dst, cfg) | (filter_sni_src(src) & (F.col("host") != ""))
    dropped = denied | F.when(F.col("method") == "CONNECT", proxy_drop).otherwise(direct_drop)
    return (
        entries.filter(~dropped)
        .withColumn("hash", conn_key("src", "src_nuid", "dst", "dst_nuid", "host"))
        .withColumn("pair_filtered", filter_conn_pair(src, dst, cfg))
        .drop("src_in", "dst_in", "_host_in", "_host_hex")
    )


def normalize_ssl(raw: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """TLS entries with a server name, after domain, pair and source filters."""
    entries = _endpoints(raw.filter(F.coalesce("server_name", F.lit("")) != ""), cfg)
    src, dst = F.col("src_in"), F.col("dst_in")
    dropped = (
        filter_domain("server_name", cfg.always_domains, cfg.never_domains)
        | filter_conn_pair(src, dst, cfg)
        | filter_sni_src(src)
    )
    return entries.filter(~dropped).drop("src_in", "dst_in")


def resolved_ips(dns: DataFrame) -> DataFrame:
    """One row per answer of an A query that parses as an address."""
    answers = dns.filter(F.col("qtype_name") == "A").withColumn("resolved_ip", F.explode("answers"))
    return (
        with_addresses(answers.drop("answers"), {"_resolved": "resolved_ip"}, canonical=True)
        .filter(F.col("_resolved").isNotNull())
        .drop("_resolved")
    )
