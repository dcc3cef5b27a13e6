"""Log-shaped views of the supplied tables, in Spark and as the same SQL for the oracle.

Each adapter is a projection of one table; nothing is sampled or cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.config import PUBLIC_NETWORK_ID, UNKNOWN_PRIVATE_NETWORK_ID

DAY0 = "2024-01-30 00:00:00"

# Extensions that are valid per MIME type.
VALID_MIME = (
    ("text/html", "html"),
    ("text/html", "htm"),
    ("application/pdf", "pdf"),
    ("text/plain", "txt"),
    ("text/plain", ""),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(column: Column, mapping: dict[str, object], default: object) -> Column:
    out = F
    for key, value in mapping.items():
        out = out.when(column == key, value)
    return out.otherwise(default)


def conn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conn_of(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def conn_of(e: DataFrame) -> DataFrame:
    """Connections from event rows, batch or stream."""
    kind = F.col("event_type")
    orig = F.floor(F.col("value") * 100).cast("bigint")
    orig_pkts = F.col("event_id") % 10 + 1
    resp_pkts = F.col("event_id") % 4
    resp = F.col("event_id") % 7 * 100
    return e.select(
        F.col("event_id").cast("string").alias("uid"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 8 + 1).cast("string")).alias("src"),
        (F.lit(40000) + F.col("event_id") % 20000).cast("int").alias("src_port"),
        _cases(
            kind,
            {
                "click": "203.0.113.10",
                "view": "203.0.113.20",
                "purchase": "198.51.100.30",
                "signup": "192.0.2.40",
            },
            "10.0.0.200",
        ).alias("dst"),
        _cases(kind, {"click": 443, "view": 80, "purchase": 443, "signup": 53}, 445).alias("dst_port"),
        F.when(kind == "signup", "udp")
        .when((kind == "error") & (F.col("event_id") % 3 == 0), "icmp")
        .otherwise("tcp")
        .alias("proto"),
        _cases(kind, {"click": "ssl", "view": "http", "purchase": "ssl", "signup": "dns"}, "").alias("service"),
        F.col("value").alias("duration"),
        orig.alias("orig_bytes"),
        resp.alias("resp_bytes"),
        orig_pkts.alias("orig_pkts"),
        resp_pkts.alias("resp_pkts"),
        (orig + orig_pkts * 40).alias("orig_ip_bytes"),
        (resp + resp_pkts * 40).alias("resp_ip_bytes"),
        _cases(kind, {"error": "REJ", "view": "S0"}, "SF").alias("conn_state"),
        (F.col("event_id") % 5).alias("missed_bytes"),
        F.when((kind == "view") & (F.col("event_id") % 5 == 0), "SH")
        .when(kind == "view", "S")
        .when(kind == "error", "Sr")
        .otherwise("ShADadfF")
        .alias("history"),
    )


def conn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per order line; sources spread over customers, targets over suppliers."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    src = F.col("o_custkey") % 16384
    dst = F.col("l_suppkey")
    octets = lambda prefix, n: F.concat(
        F.lit(prefix), F.floor(n / 128).cast("string"), F.lit("."), (n % 128 + 1).cast("string")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uid"),
        F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber")).alias("ts"),
        octets("10.1.", src).alias("src"),
        (F.lit(40000) + F.col("l_orderkey") % 20000).cast("int").alias("src_port"),
        octets("203.0.", dst).alias("dst"),
        F.lit(443).alias("dst_port"),
        F.lit("tcp").alias("proto"),
        F.lit("ssl").alias("service"),
        F.col("l_quantity").alias("duration"),
        F.floor("l_extendedprice").cast("bigint").alias("orig_bytes"),
        F.floor(F.col("l_quantity") * 10).cast("bigint").alias("resp_bytes"),
        F.col("l_quantity").cast("bigint").alias("orig_pkts"),
        F.col("l_linenumber").cast("bigint").alias("resp_pkts"),
        F.floor("l_extendedprice").cast("bigint").alias("orig_ip_bytes"),
        F.floor(F.col("l_quantity") * 10).cast("bigint").alias("resp_ip_bytes"),
        F.when(F.col("l_returnflag") == "R", "REJ").otherwise("SF").alias("conn_state"),
        F.lit(0).cast("bigint").alias("missed_bytes"),
        F.lit("ShADadfF").alias("history"),
    )


def _order_pair(key: str) -> tuple[Column, Column, Column]:
    n = F.col(key)
    return (
        F.timestamp_seconds(F.unix_seconds(F.lit(DAY0).cast("timestamp")) + n * 7 % 86400),
        F.concat(F.lit("10.0.1."), (n % 20 + 1).cast("string")),
        F.concat(F.lit("198.51.100."), (n % 7 + 1).cast("string")),
    )


#: Sources that use names; the others only have connections.
NAMED_SOURCES = 17


def conn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One connection per order within one day; ``is_open`` marks pending orders.

    Sources 18 to 20 use no names (no HTTP, no TLS); pending orders of source 20 go to a
    destination that is never seen closed.
    """
    ts, src, dst = _order_pair("o_orderkey")
    only_open = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 20 == 19)
    dst = F.when(only_open, "198.51.100.9").otherwise(dst)
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("uid"),
        ts.alias("ts"),
        src.alias("src"),
        (F.lit(40000) + F.col("o_orderkey") % 20000).cast("int").alias("src_port"),
        dst.alias("dst"),
        F.when(F.col("o_orderstatus") == "F", 443).otherwise(80).alias("dst_port"),
        F.lit("tcp").alias("proto"),
        F.when(F.col("o_orderstatus") == "F", "ssl").otherwise("http").alias("service"),
        F.floor(price / 1000).cast("double").alias("duration"),
        F.floor(price).cast("bigint").alias("orig_bytes"),
        F.floor(price / 3).cast("bigint").alias("resp_bytes"),
        (F.floor(price / 500) + 1).cast("bigint").alias("orig_pkts"),
        (F.floor(price / 900) + 1).cast("bigint").alias("resp_pkts"),
        (F.floor(price) + 40).cast("bigint").alias("orig_ip_bytes"),
        (F.floor(price / 3) + 40).cast("bigint").alias("resp_ip_bytes"),
        F.lit("SF").alias("conn_state"),
        F.lit(0).cast("bigint").alias("missed_bytes"),
        F.lit("ShADadfF").alias("history"),
        (F.col("o_orderstatus") == "P").alias("is_open"),
    )


def http_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order line; for each fiftieth order eight of them, so that some connections have many."""
    ts, src, dst = _order_pair("l_orderkey")
    flag = F.col("l_returnflag")
    times = F.sequence(F.lit(0), F.when(F.col("l_orderkey") % 50 == 0, 7).otherwise(0))
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 20 < NAMED_SOURCES)
    lines = lines.select("*", F.explode(times).alias("_again")).withColumn("l_linenumber", F.col("l_linenumber") + 10 * F.col("_again"))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("uid"),
        F.timestamp_seconds(F.unix_seconds(ts) + F.col("l_linenumber")).alias("ts"),
        src.alias("src"),
        (F.lit(40000) + F.col("l_orderkey") % 20000).cast("int").alias("src_port"),
        dst.alias("dst"),
        F.lit(80).alias("dst_port"),
        F.col("l_linenumber").cast("bigint").alias("trans_depth"),
        F.when(flag == "R", "CONNECT").otherwise("GET").alias("method"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "")
        .otherwise(F.concat(F.lit("h"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example.com")))
        .alias("host"),
        F.concat(
            F.lit("/p/"),
            F.col("l_partkey").cast("string"),
            F.when(flag == "A", ".html?x=1").when(flag == "N", ".exe").otherwise(""),
        ).alias("uri"),
        F.concat(F.lit("http://r"), (F.col("l_partkey") % 3).cast("string"), F.lit(".example.org/")).alias("referrer"),
        F.concat(
            F.lit("agent/"), F.when(flag == "R", F.col("l_suppkey")).otherwise(F.col("l_partkey") % 50).cast("string")
        ).alias("user_agent"),
        F.when(flag == "A", F.array(F.lit("text/html")))
        .when(flag == "N", F.array(F.lit("application/pdf")))
        .otherwise(F.array(F.lit("text/plain"), F.lit("image/png")))
        .alias("dst_mime_types"),
    )


def ssl_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TLS handshake per order."""
    ts, src, dst = _order_pair("o_orderkey")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 20 < NAMED_SOURCES).select(
        F.col("o_orderkey").cast("string").alias("uid"),
        ts.alias("ts"),
        src.alias("src"),
        (F.lit(40000) + F.col("o_orderkey") % 20000).cast("int").alias("src_port"),
        dst.alias("dst"),
        F.lit(443).alias("dst_port"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 25).cast("string"), F.lit(".example.net")).alias("server_name"),
        F.md5("o_orderpriority").alias("ja3"),
        F.md5("o_orderstatus").alias("ja3s"),
        F.concat(F.lit("TLSv1"), (F.col("o_orderkey") % 4).cast("string")).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "ok").otherwise("self signed").alias("validation_status"),
        F.lit(True).alias("established"),
    )


def dns_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One A query per page, answered by an address and an alias."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        n.cast("string").alias("uid"),
        F.timestamp_seconds(F.unix_seconds(F.lit(DAY0).cast("timestamp")) + n * 60).alias("ts"),
        F.concat(F.lit("10.0.1."), (n % 8 + 1).cast("string")).alias("src"),
        (F.lit(50000) + n % 1000).cast("int").alias("src_port"),
        F.lit("10.0.0.53").alias("dst"),
        F.lit(53).alias("dst_port"),
        host.alias("query"),
        F.lit("A").alias("qtype_name"),
        F.array(
            F.concat(F.lit("198.51.100."), (n % 9 + 1).cast("string")), F.concat(F.lit("alias."), host)
        ).alias("answers"),
    )


def intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed addresses (nations of one region) and listed names (suppliers in debt)."""
    ips = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(
        F.concat(F.lit("198.51.100."), (F.col("n_nationkey") + 1).cast("string")).alias("ip"),
        F.lit("").alias("fqdn"),
    )
    names = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(
        F.lit("").alias("ip"),
        F.concat(F.lit("h"), (F.col("s_suppkey") % 20).cast("string"), F.lit(".example.com")).alias("fqdn"),
    )
    return ips.unionByName(names).distinct()


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-derived inventory: the alert destinations and more."""
    s = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return s.select(
        F.concat(F.lit("198.51.100."), F.col("s_suppkey").cast("string")).alias("ip"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 0, "critical").when(F.col("s_acctbal") < 5000, "standard").otherwise("unknown").alias("criticality"),
        F.col("n_name").alias("zone"),
    )


def alerts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per event."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    digest = F.md5(F.col("event_id").cast("string"))
    cls = _cases(
        kind,
        {"click": "beaconing", "view": "reconnaissance", "purchase": "exfiltration", "signup": "dga_dns"},
        "tls_anomaly",
    )
    return e.select(
        F.concat_ws(
            "-",
            F.substring(digest, 1, 8),
            F.substring(digest, 9, 4),
            F.concat(F.lit("4"), F.substring(digest, 14, 3)),
            F.concat(F.lit("a"), F.substring(digest, 18, 3)),
            F.substring(digest, 21, 12),
        ).alias("alert_id"),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
        ts.alias("ts"),
        F.concat(F.lit("flow_"), F.col("event_id").cast("string")).alias("flow_id"),
        cls.alias("threat_class"),
        F.when(F.col("value") > 200, "critical")
        .when(F.col("value") > 100, "high")
        .when(F.col("value") > 50, "medium")
        .when(F.col("value") > 10, "low")
        .otherwise("info")
        .alias("severity"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 40 + 1).cast("string")).alias("source"),
        F.concat(F.lit("198.51.100."), (F.col("user_id") % 7).cast("string")).alias("destination"),
        F.concat(
            F.lit('{"ja3": "'), F.md5(kind), F.lit('", "event": '), F.col("event_id").cast("string"), F.lit("}")
        ).alias("supporting_evidence"),
        F.concat(F.lit("detector_"), cls).alias("detector"),
        F.lit("1.0.0").alias("model_version"),
        F.lit("1.0.0").alias("schema_version"),
        F.lit("periodic").alias("latency_class"),
        F.when(F.col("event_id") % 5 < 2, F.concat(F.lit("capture_"), (F.col("event_id") % 5).cast("string"))).alias("pcap_id"),
    )


def valid_mime(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VALID_MIME), "mime_type string, extension string")


# ---- the same views as DuckDB SQL --------------------------------------------------

_NUID = f"CASE WHEN {{0}} LIKE '10.%' THEN '{UNKNOWN_PRIVATE_NETWORK_ID}' ELSE '{PUBLIC_NETWORK_ID}' END"


def nuid_sql(column: str) -> str:
    return _NUID.format(column)


def hex_sql(column: str) -> str:
    """Hex key of a dotted address."""
    return (
        "('00000000000000000000ffff' || "
        + " || ".join(f"printf('%02x', CAST(split_part({column}, '.', {i}) AS INTEGER))" for i in range(1, 5))
        + ")"
    )


def tld_sql(column: str) -> str:
    """Registrable domain of a name."""
    parts = f"string_split({column}, '.')"
    return (
        f"(CASE WHEN len({parts}) < 2 THEN '' "
        f"WHEN len({parts}) >= 3 AND {parts}[len({parts}) - 1] IN ('com', 'net', 'org', 'co') "
        f"THEN array_to_string({parts}[len({parts}) - 2:], '.') "
        f"ELSE array_to_string({parts}[len({parts}) - 1:], '.') END)"
    )


def sec(column: str) -> str:
    return f"CAST(floor(epoch({column})) AS BIGINT)"


_ORDER_TS = "TIMESTAMP '" + DAY0 + "' + to_seconds(CAST({0} * 7 % 86400 AS BIGINT))"

CTE: dict[str, str] = {
    "conn_events": """
SELECT CAST(event_id AS VARCHAR) AS uid, ts,
  '10.0.0.' || (user_id % 8 + 1) AS src, CAST(40000 + event_id % 20000 AS INTEGER) AS src_port,
  CASE event_type WHEN 'click' THEN '203.0.113.10' WHEN 'view' THEN '203.0.113.20'
    WHEN 'purchase' THEN '198.51.100.30' WHEN 'signup' THEN '192.0.2.40' ELSE '10.0.0.200' END AS dst,
  CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 443
    WHEN 'signup' THEN 53 ELSE 445 END AS dst_port,
  CASE WHEN event_type = 'signup' THEN 'udp' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'icmp'
    ELSE 'tcp' END AS proto,
  CASE event_type WHEN 'click' THEN 'ssl' WHEN 'view' THEN 'http' WHEN 'purchase' THEN 'ssl'
    WHEN 'signup' THEN 'dns' ELSE '' END AS service,
  value AS duration, CAST(floor(value * 100) AS BIGINT) AS orig_bytes, event_id % 7 * 100 AS resp_bytes,
  event_id % 10 + 1 AS orig_pkts, event_id % 4 AS resp_pkts,
  CAST(floor(value * 100) AS BIGINT) + (event_id % 10 + 1) * 40 AS orig_ip_bytes,
  event_id % 7 * 100 + event_id % 4 * 40 AS resp_ip_bytes,
  CASE event_type WHEN 'error' THEN 'REJ' WHEN 'view' THEN 'S0' ELSE 'SF' END AS conn_state,
  event_id % 5 AS missed_bytes,
  CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'SH' WHEN event_type = 'view' THEN 'S'
    WHEN event_type = 'error' THEN 'Sr' ELSE 'ShADadfF' END AS history
FROM events""",
    "conn_lines": """
SELECT l_orderkey || '-' || l_linenumber AS uid, l_shipdate + to_seconds(l_linenumber) AS ts,
  '10.1.' || (o_custkey % 16384) // 128 || '.' || (o_custkey % 16384 % 128 + 1) AS src,
  CAST(40000 + l_orderkey % 20000 AS INTEGER) AS src_port,
  '203.0.' || l_suppkey // 128 || '.' || (l_suppkey % 128 + 1) AS dst, 443 AS dst_port,
  'tcp' AS proto, 'ssl' AS service, l_quantity AS duration,
  CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes, CAST(floor(l_quantity * 10) AS BIGINT) AS resp_bytes,
  CAST(l_quantity AS BIGINT) AS orig_pkts, CAST(l_linenumber AS BIGINT) AS resp_pkts,
  CAST(floor(l_extendedprice) AS BIGINT) AS orig_ip_bytes, CAST(floor(l_quantity * 10) AS BIGINT) AS resp_ip_bytes,
  CASE WHEN l_returnflag = 'R' THEN 'REJ' ELSE 'SF' END AS conn_state, CAST(0 AS BIGINT) AS missed_bytes,
  'ShADadfF' AS history
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "conn_orders": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS uid, {_ORDER_TS.format('o_orderkey')} AS ts,
  '10.0.1.' || (o_orderkey % 20 + 1) AS src, CAST(40000 + o_orderkey % 20000 AS INTEGER) AS src_port,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 20 = 19 THEN '198.51.100.9' ELSE '198.51.100.' || (o_orderkey % 7 + 1) END AS dst,
  CASE WHEN o_orderstatus = 'F' THEN 443 ELSE 80 END AS dst_port, 'tcp' AS proto,
  CASE WHEN o_orderstatus = 'F' THEN 'ssl' ELSE 'http' END AS service,
  floor(o_totalprice / 1000) AS duration,
  CAST(floor(o_totalprice) AS BIGINT) AS orig_bytes, CAST(floor(o_totalprice / 3) AS BIGINT) AS resp_bytes,
  CAST(floor(o_totalprice / 500) AS BIGINT) + 1 AS orig_pkts,
  CAST(floor(o_totalprice / 900) AS BIGINT) + 1 AS resp_pkts,
  CAST(floor(o_totalprice) AS BIGINT) + 40 AS orig_ip_bytes,
  CAST(floor(o_totalprice / 3) AS BIGINT) + 40 AS resp_ip_bytes,
  'SF' AS conn_state, CAST(0 AS BIGINT) AS missed_bytes, 'ShADadfF' AS history,
  o_orderstatus = 'P' AS is_open
FROM orders""",
    "http_lines": f"""
SELECT CAST(l_orderkey AS VARCHAR) AS uid, {_ORDER_TS.format('l_orderkey')} + to_seconds(l_linenumber) AS ts,
  '10.0.1.' || (l_orderkey % 20 + 1) AS src, CAST(40000 + l_orderkey % 20000 AS INTEGER) AS src_port,
  '198.51.100.' || (l_orderkey % 7 + 1) AS dst, 80 AS dst_port, CAST(l_linenumber AS BIGINT) AS trans_depth,
  CASE WHEN l_returnflag = 'R' THEN 'CONNECT' ELSE 'GET' END AS method,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN '' ELSE 'h' || (l_suppkey % 20) || '.example.com' END AS host,
  '/p/' || l_partkey || CASE l_returnflag WHEN 'A' THEN '.html?x=1' WHEN 'N' THEN '.exe' ELSE '' END AS uri,
  'http://r' || (l_partkey % 3) || '.example.org/' AS referrer,
  'agent/' || CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE l_partkey % 50 END AS user_agent,
  CASE l_returnflag WHEN 'A' THEN ['text/html'] WHEN 'N' THEN ['application/pdf']
    ELSE ['text/plain', 'image/png'] END AS dst_mime_types
FROM (SELECT * REPLACE (l_linenumber + 10 * again AS l_linenumber)
  FROM (SELECT *, unnest(range(CASE WHEN l_orderkey % 50 = 0 THEN 8 ELSE 1 END)) AS again FROM lineitem WHERE l_orderkey % 20 < {NAMED_SOURCES}))""",
    "ssl_orders": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS uid, {_ORDER_TS.format('o_orderkey')} AS ts,
  '10.0.1.' || (o_orderkey % 20 + 1) AS src, CAST(40000 + o_orderkey % 20000 AS INTEGER) AS src_port,
  '198.51.100.' || (o_orderkey % 7 + 1) AS dst, 443 AS dst_port,
  's' || (o_custkey % 25) || '.example.net' AS server_name,
  md5(o_orderpriority) AS ja3, md5(o_orderstatus) AS ja3s, 'TLSv1' || (o_orderkey % 4) AS version,
  CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'self signed' END AS validation_status, true AS established
FROM orders WHERE o_orderkey % 20 < {NAMED_SOURCES}""",
    "dns_pages": f"""
SELECT CAST(page_id AS VARCHAR) AS uid, TIMESTAMP '{DAY0}' + to_seconds(page_id * 60) AS ts,
  '10.0.1.' || (page_id % 8 + 1) AS src, CAST(50000 + page_id % 1000 AS INTEGER) AS src_port,
  '10.0.0.53' AS dst, 53 AS dst_port,
  regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS query, 'A' AS qtype_name,
  ['198.51.100.' || (page_id % 9 + 1), 'alias.' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)] AS answers
FROM pages""",
    "intel": """
SELECT '198.51.100.' || (n_nationkey + 1) AS ip, '' AS fqdn FROM nation WHERE n_regionkey = 0
UNION SELECT '', 'h' || (s_suppkey % 20) || '.example.com' FROM supplier WHERE s_acctbal < 0""",
    "assets": """
SELECT '198.51.100.' || s_suppkey AS ip, s_name AS name,
  CASE WHEN s_acctbal < 0 THEN 'critical' WHEN s_acctbal < 5000 THEN 'standard' ELSE 'unknown' END AS criticality,
  n_name AS zone
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "alerts_events": """
SELECT substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(event_id AS VARCHAR)), 9, 4) || '-4'
    || substr(md5(CAST(event_id AS VARCHAR)), 14, 3) || '-a' || substr(md5(CAST(event_id AS VARCHAR)), 18, 3) || '-'
    || substr(md5(CAST(event_id AS VARCHAR)), 21, 12) AS alert_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, ts, 'flow_' || event_id AS flow_id,
  CASE event_type WHEN 'click' THEN 'beaconing' WHEN 'view' THEN 'reconnaissance'
    WHEN 'purchase' THEN 'exfiltration' WHEN 'signup' THEN 'dga_dns' ELSE 'tls_anomaly' END AS threat_class,
  CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'high' WHEN value > 50 THEN 'medium'
    WHEN value > 10 THEN 'low' ELSE 'info' END AS severity,
  least(1.0, value / 500) AS confidence,
  '10.0.0.' || (user_id % 40 + 1) AS source, '198.51.100.' || (user_id % 7) AS destination,
  '{"ja3": "' || md5(event_type) || '", "event": ' || event_id || '}' AS supporting_evidence,
  'detector_' || CASE event_type WHEN 'click' THEN 'beaconing' WHEN 'view' THEN 'reconnaissance'
    WHEN 'purchase' THEN 'exfiltration' WHEN 'signup' THEN 'dga_dns' ELSE 'tls_anomaly' END AS detector,
  '1.0.0' AS model_version, '1.0.0' AS schema_version, 'periodic' AS latency_class,
  CASE WHEN event_id % 5 < 2 THEN 'capture_' || (event_id % 5) END AS pcap_id
FROM events""",
    "valid_mime": "SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', '{e}')" for m, e in VALID_MIME)
    + ") AS v(mime_type, extension)",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the CTEs it needs, directly or through another CTE, in order."""
    known = {**CTE, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            used = re.search(rf"\b(?:FROM|JOIN)\s+(?:\w+(?:\s+\w+)?,\s*)*{name}\b", text)
            if name not in needed and used and known[name] is not text:
                visit(known[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{name} AS ({known[name]})" for name in needed)
    return f"WITH {head}\n{body}"
