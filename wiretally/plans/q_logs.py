"""Queries over single log rows: normalisation, filters, keys and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.config import FilterConfig, PRIVATE_SUBNETS
from wiretally.functions import domains, net
from wiretally.operators import hourly, linking, normalize, tls
from wiretally.plans import adapters as ad
from wiretally.plans.logs import SQL, OrderLogs, stored_logs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = ad.sql(oracle, {**SQL, **(extra or {})})
        return function

    return register


def secs(column: str, alias: str | None = None):
    return F.unix_seconds(column).alias(alias or column)


_N = ad.nuid_sql


@query(
    "p01_normalize_conn",
    f"""SELECT md5(uid) AS zeek_uid, epoch(date_trunc('second', ts))::BIGINT AS ts,
      md5(src || {_N('src')} || dst || {_N('dst')}) AS hash, src LIKE '10.%' AS src_local, dst LIKE '10.%' AS dst_local,
      (src LIKE '10.%') = (dst LIKE '10.%') AS filtered, CASE WHEN proto = 'icmp' THEN src_port ELSE -1 END AS icmp_type,
      CASE WHEN proto = 'icmp' THEN dst_port ELSE -1 END AS icmp_code, orig_ip_bytes AS src_ip_bytes, resp_pkts AS dst_packets FROM conn_events""",
)
def normalize_conn(spark, d):
    return normalize.normalize_conn(ad.conn_events(spark, d)).select(
        "zeek_uid", secs("ts"), "hash", "src_local", "dst_local", "filtered", "icmp_type", "icmp_code", "src_ip_bytes", "dst_packets"
    )


@query(
    "p02_normalize_dns",
    f"SELECT uid, query, tld, hash, {ad.sec('ts')} AS ts, src_nuid FROM dns",
)
def normalize_dns(spark, d):
    return stored_logs(spark, d).dns.select("uid", "query", "tld", "hash", secs("ts"), "src_nuid")


@query(
    "p03_normalize_http",
    f"""SELECT uid, host, method, md5(src || {_N('src')} || dst || {_N('dst')} || host) AS hash FROM http_lines
    WHERE host <> 'h3.example.com' AND NOT host LIKE '%7.example.com'""",
)
def normalize_http(spark, d):
    cfg = FilterConfig(never_domains=("h3.example.com", "*7.example.com"))
    return normalize.normalize_http(ad.http_lines(spark, d), cfg).select("uid", "host", "method", "hash")


@query(
    "p04_normalize_ssl",
    f"SELECT uid, server_name, md5(uid) AS zeek_uid, {_N('dst')} AS dst_nuid FROM ssl_orders WHERE server_name <> 's1.example.net'",
)
def normalize_ssl(spark, d):
    cfg = FilterConfig(never_domains=("s1.example.net",))
    return normalize.normalize_ssl(ad.ssl_orders(spark, d), cfg).select("uid", "server_name", "zeek_uid", "dst_nuid")


@query(
    "p05_conn_keys",
    f"""SELECT src, dst, md5(src || {_N('src')} || dst || {_N('dst')}) AS pair_key, md5(src || {_N('src')} || service) AS name_key,
      md5(src || dst || service) AS query_key, count(*) AS n FROM conn_events GROUP BY ALL""",
)
def conn_keys(spark, d):
    c = net.with_addresses(ad.conn_events(spark, d), {"sh": "src", "dh": "dst"})
    c = net.with_membership(c, {"s": "sh", "t": "dh"}, {"private": net.NON_PUBLIC})
    none = F.lit(None).cast("string")
    c = c.withColumn("sn", net.network_id(F.col("s.private"), none)).withColumn("dn", net.network_id(F.col("t.private"), none))
    return c.groupBy(
        "src",
        "dst",
        net.conn_key("src", "sn", "dst", "dn").alias("pair_key"),
        net.conn_key("src", "sn", "service").alias("name_key"),
        net.conn_key("src", "dst", "service").alias("query_key"),
    ).agg(F.count(F.lit(1)).alias("n"))


_AGENT = "CASE WHEN event_type = 'click' THEN substr(md5(event_type), 1, 8) || '-1111-2222-3333-' || substr(md5(event_type), 9, 12) WHEN event_type = 'view' THEN 'bad' END"


@query(
    "p06_network_id",
    f"""SELECT ip, agent, count(*) AS n, CASE WHEN ip NOT LIKE '10.%' THEN 'ffffffff-ffff-ffff-ffff-ffffffffffff'
      WHEN agent LIKE '%-1111-%' THEN agent ELSE 'ffffffff-ffff-ffff-ffff-fffffffffffe' END AS nuid
    FROM (SELECT CASE WHEN user_id % 2 = 0 THEN '10.0.0.' || user_id % 250 ELSE '8.8.4.' || user_id % 250 END AS ip, {_AGENT} AS agent FROM events) GROUP BY ALL""",
)
def network_id(spark, d):
    kind = F.col("event_type")
    e = ad.table(spark, d, "events").select(
        F.concat(F.when(F.col("user_id") % 2 == 0, "10.0.0.").otherwise("8.8.4."), (F.col("user_id") % 250).cast("string")).alias("ip"),
        F.when(kind == "click", F.concat(F.substring(F.md5(kind), 1, 8), F.lit("-1111-2222-3333-"), F.substring(F.md5(kind), 9, 12)))
        .when(kind == "view", "bad")
        .alias("agent"),
    )
    e = net.with_addresses(e, {"h": "ip"}).withColumn("nuid", net.network_id(net.in_subnets("h", net.NON_PUBLIC), "agent"))
    return e.groupBy("ip", "agent", "nuid").agg(F.count(F.lit(1)).alias("n"))


# Addresses spread over many networks, from the customer table.
_IPS = {
    "ips": """SELECT c_custkey AS id, CASE c_nationkey % 5 WHEN 0 THEN '10.' WHEN 1 THEN '172.' WHEN 2 THEN '192.168.' WHEN 3 THEN '127.0.' ELSE '203.0.' END
      || CASE WHEN c_nationkey % 5 < 2 THEN (c_custkey % 40) || '.' ELSE '' END || (c_custkey % 200) || '.' || (c_custkey % 100) AS ip FROM customer""",
    "ranges": f"""SELECT '{{}}' AS lo""",
    "marked": f"""SELECT id, ip, {ad.hex_sql('ip')} AS hex FROM ips""",
}


def _ips(spark, d):
    c = ad.table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    text = lambda x: x.cast("string")
    return c.select(
        k.alias("id"),
        F.concat(
            F.when(n == 0, "10.").when(n == 1, "172.").when(n == 2, "192.168.").when(n == 3, "127.0.").otherwise("203.0."),
            F.when(n < 2, F.concat(text(k % 40), F.lit("."))).otherwise(""),
            text(k % 200),
            F.lit("."),
            text(k % 100),
        ).alias("ip"),
    )


def in_sql(cidrs: tuple[str, ...], column: str = "hex") -> str:
    bounds = [net.cidr_bounds(c) for c in cidrs]
    return "(" + " OR ".join(f"{column} BETWEEN '{a}' AND '{b}'" for a, b in bounds) + ")" if bounds else "false"


@query("p07_is_internal", f"SELECT id, hex, {in_sql(PRIVATE_SUBNETS)} AS internal FROM marked", _IPS)
def is_internal(spark, d):
    m = net.with_addresses(_ips(spark, d), {"hex": "ip"})
    return m.select("id", "hex", net.in_subnets("hex", PRIVATE_SUBNETS).alias("internal"))


_FILTERS = FilterConfig(always_subnets=("203.0.5.0/24",), never_subnets=("127.0.0.0/8", "172.3.0.0/16"))
_PAIRS = {
    **_IPS,
    "pairs": """SELECT a.id, a.ip AS src, b.ip AS dst, a.hex AS sh, b.hex AS dh FROM marked a JOIN marked b ON b.id = (a.id * 7 + 3) % (SELECT count(*) FROM customer)""",
}


def _pairs(spark, d):
    m = net.with_addresses(_ips(spark, d), {"hex": "ip"})
    total = ad.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("total"))
    a = m.crossJoin(F.broadcast(total)).select(
        "id", F.col("hex").alias("sh"), ((F.col("id") * 7 + 3) % F.col("total")).alias("other")
    )
    b = m.select(F.col("id").alias("other"), F.col("hex").alias("dh"))
    lists = normalize.membership_lists(_FILTERS)
    return net.with_membership(a.join(b, "other"), {"s": "sh", "t": "dh"}, lists)


_ALW = f"({in_sql(_FILTERS.always_subnets, 'sh')} OR {in_sql(_FILTERS.always_subnets, 'dh')})"
_NEV = f"({in_sql(_FILTERS.never_subnets, 'sh')} OR {in_sql(_FILTERS.never_subnets, 'dh')})"
_SI, _DI = in_sql(PRIVATE_SUBNETS, "sh"), in_sql(PRIVATE_SUBNETS, "dh")


@query(
    "p08_filter_conn_pair",
    f"""SELECT id, CASE WHEN {_ALW} THEN false WHEN {_NEV} THEN true WHEN {_SI} AND {_DI} THEN true
      WHEN NOT {_SI} AND NOT {_DI} THEN true WHEN NOT {_SI} AND {_DI} THEN true ELSE false END AS dropped FROM pairs""",
    _PAIRS,
)
def filter_conn_pair(spark, d):
    return _pairs(spark, d).select("id", normalize.filter_conn_pair(F.col("s"), F.col("t"), _FILTERS).alias("dropped"))


@query(
    "p09_filter_conn_pair_http",
    f"""SELECT id, CASE WHEN {_ALW} THEN false WHEN {_NEV} THEN true WHEN NOT {_SI} AND NOT {_DI} THEN true ELSE false END AS dropped FROM pairs""",
    _PAIRS,
)
def filter_conn_pair_http(spark, d):
    return _pairs(spark, d).select("id", normalize.filter_conn_pair_http(F.col("s"), F.col("t")).alias("dropped"))


@query(
    "p10_filter_dns_pair",
    f"""SELECT id, CASE WHEN {_ALW} THEN false WHEN {_NEV} THEN true WHEN NOT {_SI} AND NOT {_DI} THEN true
      WHEN NOT {_SI} AND {_DI} THEN true ELSE false END AS dropped FROM pairs""",
    _PAIRS,
)
def filter_dns_pair(spark, d):
    return _pairs(spark, d).select("id", normalize.filter_dns_pair(F.col("s"), F.col("t"), _FILTERS).alias("dropped"))


@query(
    "p11_filter_single",
    f"""SELECT id, NOT {in_sql(_FILTERS.always_subnets)} AND {in_sql(_FILTERS.never_subnets)} AS ip_dropped, NOT {in_sql(PRIVATE_SUBNETS)} AS sni_dropped FROM marked""",
    _IPS,
)
def filter_single(spark, d):
    m = net.with_addresses(_ips(spark, d), {"hex": "ip"})
    m = net.with_membership(m, {"ip_in": "hex"}, normalize.membership_lists(_FILTERS))
    return m.select(
        "id",
        normalize.filter_ip(F.col("ip_in")).alias("ip_dropped"),
        normalize.filter_sni_src(F.col("ip_in")).alias("sni_dropped"),
    )


@query(
    "p12_filter_domain",
    """SELECT page_id, host, (host LIKE '%.example.org' OR host = 'example.org') AND NOT (host LIKE '%.thther.example.org' OR host = 'thther.example.org') AS dropped
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)""",
)
def filter_domain(spark, d):
    q = ad.dns_pages(spark, d)
    dropped = domains.filter_domain("query", ("*.thther.example.org",), ("*.example.org",))
    return q.select(F.col("uid").cast("bigint").alias("page_id"), F.col("query").alias("host"), dropped.alias("dropped"))


@query(
    "p12_deny_list_join",
    """SELECT uid, query FROM dns_pages WHERE NOT EXISTS (SELECT 1 FROM (
      SELECT 'h' || s_suppkey || '.example.com' AS p FROM supplier UNION ALL SELECT '*.' || lower(p_brandless) || '.example.net' FROM (SELECT 'blog' AS p_brandless))
      WHERE query = p OR (p LIKE '*%' AND (query LIKE replace(p, '*', '%') OR query = replace(p, '*.', ''))))""",
)
def deny_list(spark, d):
    names = ad.table(spark, d, "supplier").select(
        F.concat(F.lit("h"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("pattern")
    )
    wild = spark.createDataFrame([("*.blog.example.net",)], "pattern string")
    return domains.drop_denied_domains(ad.dns_pages(spark, d), "query", names.unionByName(wild)).select("uid", "query")


@query(
    "p13_cidr_ranges",
    "SELECT a.id, count(*) AS lists FROM marked a JOIN ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS list, '{lo}' AS lo, '{hi}' AS hi"
        for name, cidrs in (("internal", PRIVATE_SUBNETS), ("never", _FILTERS.never_subnets))
        for lo, hi in map(net.cidr_bounds, cidrs)
    )
    + ") r ON a.hex BETWEEN r.lo AND r.hi GROUP BY a.id",
    _IPS,
)
def cidr_ranges(spark, d):
    m = net.with_addresses(_ips(spark, d), {"hex": "ip"})
    ranges = net.cidr_ranges(spark, {"internal": PRIVATE_SUBNETS, "never": _FILTERS.never_subnets})
    hits = m.join(F.broadcast(ranges), F.col("hex").between(F.col("lo"), F.col("hi")))  # configured subnets only
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("lists"))


@query(
    "p14_unfiltered",
    "SELECT uid FROM conn_events WHERE dst NOT LIKE '10.%'",
)
def unfiltered(spark, d):
    n = normalize.unfiltered(normalize.normalize_conn(ad.conn_events(spark, d)))
    return ad.conn_events(spark, d).withColumn("zeek_uid", F.md5("uid")).join(n.select("zeek_uid"), "zeek_uid", "left_semi").select("uid")


@query("p15_resolved_ips", "SELECT uid, query, resolved_ip FROM resolved")
def resolved_ips(spark, d):
    return normalize.resolved_ips(stored_logs(spark, d).dns).select("uid", "query", "resolved_ip")


@query(
    "p24_is_fqdn",
    """SELECT page_id, kind, regexp_full_match(name, '(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\\.)+[a-zA-Z]{2,}') AS valid
    FROM (SELECT page_id, unnest([{'kind': 'host', 'name': regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)}, {'kind': 'url', 'name': url},
      {'kind': 'dash', 'name': '-' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)}], recursive := true) FROM pages)""",
)
def fqdn_check(spark, d):
    p = ad.table(spark, d, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    names = F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("name")),
        F.struct(F.lit("url").alias("kind"), F.col("url").alias("name")),
        F.struct(F.lit("dash").alias("kind"), F.concat(F.lit("-"), host).alias("name")),
    )
    return p.select("page_id", F.inline(names)).select("page_id", "kind", domains.is_fqdn("name").alias("valid"))


@query(
    "p25_exportable_domain",
    """SELECT uid, NOT (name LIKE '%.arpa' OR name LIKE '%.local' OR name = '') AS keep FROM (
      SELECT uid, CASE CAST(uid AS BIGINT) % 4 WHEN 0 THEN 'in-addr.arpa' WHEN 1 THEN 'printer.local' WHEN 2 THEN '' ELSE tld END AS name FROM dns)""",
)
def exportable(spark, d):
    n = F.col("uid").cast("bigint") % 4
    name = F.when(n == 0, "in-addr.arpa").when(n == 1, "printer.local").when(n == 2, "").otherwise(F.col("tld"))
    return stored_logs(spark, d).dns.withColumn("name", name).select("uid", domains.is_exportable_domain("name").alias("keep"))


@query("p26_since", "SELECT uid FROM conn_events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-20 13:00:00'")
def since(spark, d):
    c = ad.conn_events(spark, d).withColumn("hour", hourly.hour())
    return hourly.since(c, F.lit("2024-01-20 13:37:00").cast("timestamp")).select("uid")


@query(
    "p30_port_label",
    """SELECT CASE WHEN proto = 'icmp' THEN 'icmp:' || src_port || '/' || dst_port ELSE dst_port || ':' || proto || ':' || service END AS label, count(*) AS n
    FROM conn_events GROUP BY 1""",
)
def port_label(spark, d):
    c = ad.conn_events(spark, d)
    return c.groupBy(net.port_label("proto", "src_port", "dst_port", "service").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_registrable_domain",
    f"SELECT query, {ad.tld_sql('query')} AS tld, {ad.tld_sql('deep')} AS deep_tld, {ad.tld_sql('plain')} AS plain_tld FROM (SELECT DISTINCT query, replace(query, 'example.', 'co.') AS deep, split_part(query, '.', 1) AS plain FROM dns_pages)",
)
def registrable(spark, d):
    q = ad.dns_pages(spark, d).select("query").distinct()
    return q.select(
        "query",
        domains.registrable_domain("query").alias("tld"),
        domains.registrable_domain(F.replace("query", F.lit("example."), F.lit("co."))).alias("deep_tld"),
        domains.registrable_domain(F.get(F.split("query", r"\."), F.lit(0))).alias("plain_tld"),
    )


@query(
    "fn_path_extension",
    """SELECT ext, count(*) AS n FROM (SELECT CASE WHEN NOT contains(seg, '.') OR seg LIKE '%.' THEN '' ELSE string_split(seg, '.')[-1] END AS ext
      FROM (SELECT string_split(regexp_replace(uri, '[?#].*$', ''), '/')[-1] AS seg FROM http_lines)) GROUP BY 1""",
)
def extensions(spark, d):
    return ad.http_lines(spark, d).groupBy(hourly.path_extension(F.col("uri")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


# ---- links -------------------------------------------------------------------------


@query(
    "w01_rank_requests",
    "SELECT uid, trans_depth, host, CAST(rn AS INTEGER) AS rn FROM ranked",
)
def rank_requests(spark, d):
    return linking.rank_requests(OrderLogs(spark, d).http_tmp).select("uid", "trans_depth", "host", "rn")


_LINK = "zeek_uid, hash, host, method, multi_request, src_ip_bytes, dst_packets, duration, conn_state, service"


@query("j01_link_http", f"SELECT {_LINK}, uri, {ad.sec('ts')} AS ts FROM http")
def link_http(spark, d):
    return OrderLogs(spark, d).http.select(*_LINK.split(", "), "uri", secs("ts"))


@query(
    "j01_missing_host_rows",
    "SELECT zeek_uid, hash, missing_host_useragent, src, dst, src_port FROM conn WHERE missing_host_header",
)
def missing_host(spark, d):
    return OrderLogs(spark, d).conn.filter("missing_host_header").select("zeek_uid", "hash", "missing_host_useragent", "src", "dst", "src_port")


@query("j02_link_ssl", f"SELECT zeek_uid, hash, server_name, ja3, src_ip_bytes, duration, {ad.sec('ts')} AS ts FROM ssl")
def link_ssl(spark, d):
    return OrderLogs(spark, d).ssl.select("zeek_uid", "hash", "server_name", "ja3", "src_ip_bytes", "duration", secs("ts"))


_FIRST = {
    "ssl_twice": """SELECT uid, ts, server_name, ja3 FROM ssl_orders UNION ALL SELECT uid, ts + INTERVAL 1 SECOND, 'late.example.net', ja3 FROM ssl_orders""",
    "conn_twice": """SELECT uid, ts, orig_bytes, resp_bytes FROM conn_orders UNION ALL SELECT uid, ts + INTERVAL 5 SECOND, 0, 0 FROM conn_orders
      UNION ALL SELECT '', TIMESTAMP '2000-01-01', 1, 1 FROM region""",
}


@query(
    "j03_join_ssl_conn",
    f"""SELECT s.uid, s.server_name, s.ja3, c.orig_bytes, c.resp_bytes, {ad.sec('s.ts')} AS ts
    FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts) AS r FROM ssl_twice) s
    JOIN (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts) AS r FROM conn_twice WHERE uid <> '') c ON s.uid = c.uid AND s.r = 1 AND c.r = 1""",
    _FIRST,
)
def join_ssl_conn(spark, d):
    s = ad.ssl_orders(spark, d).select("uid", "ts", "server_name", "ja3")
    c = ad.conn_orders(spark, d).select("uid", "ts", "orig_bytes", "resp_bytes")
    late_s = s.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")).withColumn("server_name", F.lit("late.example.net"))
    zero = F.lit(0).cast("bigint")
    late_c = c.withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 SECOND")).withColumn("orig_bytes", zero).withColumn("resp_bytes", zero)
    blank = ad.table(spark, d, "region").select(
        F.lit("  ").alias("uid"), F.lit("2000-01-01").cast("timestamp").alias("ts"), (zero + 1).alias("orig_bytes"), (zero + 1).alias("resp_bytes")
    )
    return tls.join_ssl_conn(s.unionByName(late_s), c.unionByName(late_c).unionByName(blank)).select(
        "uid", "server_name", "ja3", "orig_bytes", "resp_bytes", secs("ts")
    )


_UIDS = {
    "sni_totals": """SELECT u.hash, ts_unique, c AS count, dur FROM (SELECT hash, max(n) AS ts_unique FROM (
        SELECT hash, proxy, count(DISTINCT ts) AS n FROM sni_rows GROUP BY ALL) GROUP BY hash) u
      JOIN (SELECT hash, sum(count) AS c, sum(total_duration) AS dur FROM usni GROUP BY hash) t ON u.hash = t.hash
      WHERE (ts_unique >= 4 AND c < 86400) OR dur >= 3600""",
    "sni_keys": "SELECT hash, zeek_uid FROM http WHERE host <> '' UNION SELECT hash, zeek_uid FROM ssl",
    "open_sni_keys": "SELECT hash, zeek_uid FROM open_http WHERE host <> '' UNION SELECT hash, zeek_uid FROM open_ssl",
    "used_uids": "SELECT zeek_uid FROM sni_keys JOIN sni_totals USING (hash) UNION SELECT zeek_uid FROM open_sni_keys",
}


def sni_keys(logs: OrderLogs, opened: bool = False):
    http, ssl = (logs.open_http, logs.open_ssl) if opened else (logs.http, logs.ssl)
    return http.filter(F.col("host") != "").select("hash", "zeek_uid").union(ssl.select("hash", "zeek_uid")).distinct()


def sni_uids(logs: OrderLogs):
    from wiretally.operators.rollups import sni_seconds

    totals = (
        logs.usni.groupBy("hash")
        .agg(F.sum("count").alias("count"), F.sum("total_duration").alias("total_duration"))
        .join(sni_seconds(logs.sni_rows), "hash")
    )
    return linking.sni_uids(totals, sni_keys(logs), sni_keys(logs, True))


def pair_keys(logs: OrderLogs):
    """Keys of closed and of open connections: a pair may only ever be seen open."""
    return logs.conn.select("hash", "zeek_uid").union(logs.open_conn.select("hash", "zeek_uid"))


@query("j04_sni_uids", "SELECT zeek_uid FROM used_uids", _UIDS)
def sni_uids_query(spark, d):
    return sni_uids(stored_logs(spark, d))


@query(
    "j05_ip_only_keys",
    """SELECT k.hash FROM (SELECT hash, zeek_uid FROM conn UNION SELECT hash, zeek_uid FROM open_conn) k LEFT JOIN used_uids u ON k.zeek_uid = u.zeek_uid
    GROUP BY k.hash HAVING count(u.zeek_uid) = 0""",
    _UIDS,
)
def ip_only(spark, d):
    logs = stored_logs(spark, d)
    return linking.ip_only_keys(pair_keys(logs), sni_uids(logs))


_EV = {
    "evk": """SELECT md5(src || dst) AS hash, md5(uid) AS zeek_uid, severe FROM (SELECT c.*, duration > 400 AS severe FROM conn_events c)""",
}


@query(
    "j05_ip_only_keys_events",
    """SELECT k.hash FROM evk k LEFT JOIN (SELECT DISTINCT zeek_uid FROM evk WHERE severe) u ON k.zeek_uid = u.zeek_uid GROUP BY k.hash HAVING count(u.zeek_uid) = 0""",
    _EV,
)
def ip_only_events(spark, d):
    keys = ad.conn_events(spark, d).select(F.md5(F.concat("src", "dst")).alias("hash"), F.md5("uid").alias("zeek_uid"), "duration")
    return linking.ip_only_keys(keys.drop("duration"), keys.filter("duration > 400").select("zeek_uid"))
