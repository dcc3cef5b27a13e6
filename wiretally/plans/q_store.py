"""Queries over sources and sinks: tables are written in the log formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import flow
from wiretally.operators.anomaly import prepare_features
from wiretally.plans import adapters as ad
from wiretally.plans.q_alerts import stored
from wiretally.plans.q_hourly import secs
from wiretally.plans.q_scores import raw_findings
from wiretally.session import fresh_path
from wiretally.sources import logs, reference, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = ad.sql(oracle, {**_CTE, **(extra or {})})
        return function

    return register


_CTE = {
    "stored": """SELECT *, CASE WHEN severity <> 'info' THEN 'inc_' || source || '_' || substr(timestamp, 1, 10) END AS correlation_id,
      CASE WHEN severity = 'critical' THEN 'critical' ELSE 'standard' END AS asset_criticality FROM alerts_events""",
}
_CONN = "uid, src, src_port, dst, dst_port, proto, service, duration, orig_bytes, resp_pkts, conn_state, history"
_CONN_SQL = f"""SELECT uid, src, src_port, dst, dst_port, proto, CASE WHEN service <> '' THEN service END AS service, duration, orig_bytes, resp_pkts, conn_state, history,
    epoch_us(ts) AS ts_us FROM conn_events"""


def _written(df, label: str) -> str:
    path = fresh_path(df.sparkSession, label)
    df.write.text(path)
    return path


def _json_conn(spark, d):
    """Connection log lines as JSON, with comments, cut-off and incomplete lines mixed in."""
    c = ad.conn_events(spark, d)
    names = {
        "uid": "uid", "src": "id.orig_h", "src_port": "id.orig_p", "dst": "id.resp_h", "dst_port": "id.resp_p",
        "proto": "proto", "service": "service", "duration": "duration", "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes",
        "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts", "conn_state": "conn_state", "history": "history",
    }
    ts = (F.unix_micros("ts") / 1_000_000).alias("ts")
    line = F.to_json(F.struct(ts, *[F.col(k).alias(v) for k, v in names.items()]))
    good = c.select(line.alias("value"))
    cut = c.filter("proto = 'udp'").select(F.substring(line, 1, 40).alias("value"))
    partial = c.filter("proto = 'icmp'").select(F.to_json(F.struct(ts, F.col("uid"))).alias("value"))
    notes = c.filter("proto = 'icmp'").select(F.lit("# comment").alias("value"))
    return good.unionByName(cut).unionByName(partial).unionByName(notes)


@query("s01_read_zeek_json", _CONN_SQL)
def read_json(spark, d):
    read = logs.read_zeek_json(spark, _written(_json_conn(spark, d), "json"), "conn")
    return read.select(*_CONN.split(", "), F.unix_micros("ts").alias("ts_us"))


_TSV = ("ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "extra_field", "conn_state", "history", "resp_pkts")


def _tsv_conn(spark, d, gz: bool = False):
    """One tab-separated log per protocol, each with its header, sorted into place."""
    c = ad.conn_events(spark, d)
    source = {"id.orig_h": "src", "id.orig_p": "src_port", "id.resp_h": "dst", "id.resp_p": "dst_port"}
    cell = lambda n: (
        F.format_string("%d.%06d", F.floor(F.unix_micros("ts") / 1_000_000).cast("bigint"), F.unix_micros("ts") % 1_000_000)
        if n == "ts"
        else F.lit("zzz")
        if n == "extra_field"
        else F.when(F.col(source.get(n, n)).cast("string") == "", "-").otherwise(F.col(source.get(n, n)).cast("string"))
    )
    rows = c.select("proto", F.lit(1).alias("order"), F.concat_ws("\t", *[cell(n) for n in _TSV]).alias("value"))
    head = "#separator \\x09\n#set_separator\t,\n#empty_field\t(empty)\n#unset_field\t-\n#fields\t" + "\t".join(_TSV)
    heads = c.select("proto").distinct().select("proto", F.lit(0).alias("order"), F.lit(head).alias("value"))
    path = fresh_path(spark, "tsv")
    ordered = rows.unionByName(heads).repartition("proto").sortWithinPartitions("proto", "order")
    writer = ordered.select("proto", "value").write.partitionBy("proto")
    (writer.option("compression", "gzip") if gz else writer).text(path)
    return f"{path}/*"


@query("s02_read_zeek_tsv", _CONN_SQL)
def read_tsv(spark, d):
    read = logs.read_zeek_tsv(spark, _tsv_conn(spark, d, gz=True), "conn")
    return read.select(*_CONN.split(", "), F.unix_micros("ts").alias("ts_us"))


@query(
    "s03_coerce",
    """SELECT event_id, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS i, user_id AS c, CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' THEN false END AS b,
      CASE WHEN event_type = 'signup' THEN NULL ELSE 'a;' || user_id END AS v FROM events""",
)
def coerce(spark, d):
    e = ad.table(spark, d, "events")
    kind = F.col("event_type")
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    seconds = F.format_string("%d.%06d", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint"), F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000)
    c = logs.coerce_zeek
    return e.select(
        "event_id",
        F.unix_micros(c(F.when(kind == "view", stamp).otherwise(seconds), "time")).alias("t"),
        c(F.when(kind == "error", "-").otherwise(F.col("value").cast("string")), "interval").alias("i"),
        c(F.col("user_id").cast("string"), "count").alias("c"),
        c(F.when(kind == "click", "T").when(kind == "view", "F").otherwise("(empty)"), "bool").alias("b"),
        F.array_join(c(F.when(kind == "signup", "(empty)").otherwise(F.concat(F.lit("a,"), F.col("user_id").cast("string"))), "set[string]"), ";").alias("v"),
    )


@query(
    "s04_file_quality",
    """SELECT count(*) + count(*) FILTER (proto = 'udp') + count(*) FILTER (proto = 'icmp') AS lines, count(*) FILTER (proto = 'udp') AS bad_lines,
      count(*) FILTER (proto = 'udp') > 25 AS corrupt FROM conn_events""",
)
def quality(spark, d):
    path = fresh_path(spark, "quality")
    _json_conn(spark, d).coalesce(1).write.text(path)
    q = logs.file_quality(spark, path)
    return q.agg(F.sum("lines").alias("lines"), F.sum("bad_lines").alias("bad_lines"), F.max("corrupt").alias("corrupt"))


# Log files named after orders: type from the priority, day from the date.
_FILES = {
    "files": """SELECT o_orderkey AS id, '/logs/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || CASE o_orderpriority WHEN '1-URGENT' THEN 'conn' WHEN '2-HIGH' THEN 'http' WHEN '3-MEDIUM' THEN 'ssl' WHEN '4-NOT SPECIFIED' THEN 'open_http' ELSE 'conn_summary' END
        || '.' || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':00:00-next.log' || CASE WHEN o_orderstatus = 'F' THEN '.gz' ELSE '' END AS path, o_orderdate + to_seconds(o_orderkey) AS m FROM orders""",
    "classified": """SELECT id, path, split_part(path, '/', 3)::DATE AS day, regexp_extract(split_part(path, '/', 4), '^[a-z_]+') AS log_type, CAST(regexp_extract(path, '[.]([0-9]{2}):', 1) AS INTEGER) AS hour FROM (
        SELECT *, row_number() OVER (PARTITION BY regexp_replace(path, '[.]gz$', '') ORDER BY m DESC, path DESC) AS r FROM files WHERE path NOT LIKE '%conn_summary%') WHERE r = 1""",
}


def _files(spark, d):
    o = ad.table(spark, d, "orders")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "conn").when(p == "2-HIGH", "http").when(p == "3-MEDIUM", "ssl").when(p == "4-NOT SPECIFIED", "open_http").otherwise("conn_summary")
    date = F.col("o_orderdate").cast("timestamp")
    path = F.concat(
        F.lit("/logs/"), F.date_format(date, "yyyy-MM-dd"), F.lit("/"), kind, F.lit("."), F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"),
        F.lit(":00:00-next.log"), F.when(F.col("o_orderstatus") == "F", ".gz").otherwise(""),
    )
    return o.select(F.col("o_orderkey").alias("id"), path.alias("path"), F.timestamp_seconds(F.unix_seconds(date) + F.col("o_orderkey")).alias("modificationTime"))


@query("s05_discover_logs", "SELECT id, log_type, strftime(day, '%Y-%m-%d') AS day, hour FROM classified", _FILES)
def discover(spark, d):
    return logs.classify_files(_files(spark, d)).select("id", "log_type", F.col("day").cast("string").alias("day"), "hour")


@query("s06_keep_recent_days", "SELECT id FROM classified WHERE day >= (SELECT max(day) FROM classified) - 500", _FILES)
def recent_days(spark, d):
    files = logs.classify_files(_files(spark, d))
    # The newest day stands in for today.
    today = files.agg(F.max("day").alias("_today"))
    return logs.keep_recent_days(files.crossJoin(F.broadcast(today)), 500, F.col("_today")).select("id")


@query("s07_new_files", "SELECT id FROM classified WHERE path NOT IN (SELECT path FROM files WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))", _FILES)
def new_files(spark, d):
    files = logs.classify_files(_files(spark, d))
    returned = ad.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return logs.new_files(files, _files(spark, d).join(returned, "id", "left_semi")).select("id")


@query(
    "s08_valid_combinations",
    """SELECT id FROM classified c WHERE log_type = 'conn' OR (log_type IN ('http', 'ssl') AND EXISTS (SELECT 1 FROM classified k WHERE k.day = c.day AND k.hour = c.hour AND k.log_type = 'conn'))""",
    _FILES,
)
def combinations(spark, d):
    return logs.valid_combinations(logs.classify_files(_files(spark, d))).select("id")


@query(
    "s09_import_ledger",
    "SELECT 'import-' || dst AS import_id, epoch(min(ts))::BIGINT AS min_ts, epoch(max(ts))::BIGINT AS max_ts FROM (SELECT dst, date_trunc('second', ts) AS ts FROM conn_events) GROUP BY dst",
)
def ledger(spark, d):
    path = fresh_path(spark, "ledger")
    c = ad.conn_events(spark, d).withColumn("ts", F.date_trunc("second", "ts"))
    now = F.current_timestamp()
    for dst in ("203.0.113.10", "203.0.113.20", "198.51.100.30", "192.0.2.40", "10.0.0.200"):  # the adapter's targets
        logs.append_import_log(logs.import_record(c.filter(F.col("dst") == dst), f"import-{dst}", now, now), path)
    return spark.read.parquet(path).select("import_id", *secs("min_ts", "max_ts"))


@query(
    "s10_read_findings_csv",
    """SELECT '10.0.1.' || (o_orderkey % 20 + 1) AS src, CASE WHEN o_totalprice > 450000 THEN 'n/a' ELSE CAST(round(o_totalprice / 500000, 3) AS VARCHAR) END AS score, CAST(o_custkey AS VARCHAR) AS connections,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_custkey % 3 + 80) || ':tcp:' || CASE WHEN o_custkey % 2 = 0 THEN 'http' ELSE '' END || ',443:tcp:ssl' END AS ports FROM orders""",
)
def read_findings(spark, d):
    raw = raw_findings(spark, d).select(*[F.col(f"`{c}`") for c in reference.FINDINGS_COLUMNS])
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in reference.FINDINGS_COLUMNS]))
    body = raw.select(F.lit(1).alias("order"), line.alias("value"))
    banner = ["Viewing database: today", "", ",".join(reference.FINDINGS_COLUMNS)]
    head = ad.table(spark, d, "region").limit(1).select(F.lit(0).alias("order"), F.explode(F.array(*[F.lit(b) for b in banner])).alias("value"))
    path = fresh_path(spark, "report")
    body.unionByName(head).coalesce(1).sortWithinPartitions("order").select("value").write.text(path)
    f = reference.read_findings_csv(spark, path)
    return f.select(F.col("`Source IP`").alias("src"), F.col("`Beacon Score`").alias("score"), F.col("`Connection Count`").alias("connections"), F.col("`Port:Proto:Service`").alias("ports"))


@query("s11_write_findings_csv", "SELECT '10.0.1.' || (o_orderkey % 20 + 1) AS src, count(*) AS n FROM orders GROUP BY 1")
def write_findings(spark, d):
    path = fresh_path(spark, "findings")
    reference.write_findings_csv(raw_findings(spark, d).drop("id"), path)
    return spark.read.option("header", True).csv(path).groupBy(F.col("`Source IP`").alias("src")).agg(F.count(F.lit(1)).alias("n"))


_FEED = {
    "entries": """SELECT 'feed-' || s_nationkey % 3 AS feed, '203.0.' || s_suppkey // 256 || '.' || s_suppkey % 256 AS ip, '' AS fqdn FROM supplier
      UNION SELECT 'feed-' || s_nationkey % 3, '', 'bad' || s_suppkey || '.example.com' FROM supplier WHERE s_acctbal < 5000""",
}


def _feeds(spark, d):
    s = ad.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    text = lambda x: x.cast("string")
    feed = F.concat(F.lit("feed-"), text(F.col("s_nationkey") % 3))
    ip = F.concat(F.lit("203.0."), text(F.floor(k / 256)), F.lit("."), text(k % 256))
    name = F.when(F.col("s_acctbal") < 5000, F.concat(F.lit("bad"), text(k), F.lit(".example.com"))).otherwise(F.concat(F.lit("# note "), text(k)))
    lines = F.array(ip, name, F.lit("// comment"), F.lit("<!-- x -->"), F.concat(F.lit("not valid "), text(k)), F.lit(""))
    return s.select(feed.alias("feed"), F.explode(lines).alias("value"))


@query("s12_read_intel_feed", "SELECT feed, ip, fqdn FROM entries", _FEED)
def intel_feed(spark, d):
    path = fresh_path(spark, "feeds")
    _feeds(spark, d).write.partitionBy("feed").text(path)
    f = reference.read_intel_feed(spark, f"{path}/*")
    return f.select(F.regexp_extract("feed", r"feed=([^/]+)", 1).alias("feed"), "ip", "fqdn").distinct()


_SYNC = {
    "cur": "SELECT 'f' || s_nationkey % 4 AS feed, 'v1' AS feed_hash, 'old' || s_suppkey || '.com' AS fqdn FROM supplier",
    "inc": "SELECT 'f' || s_nationkey % 5 AS feed, CASE WHEN s_nationkey % 5 IN (1, 4) THEN 'v2' ELSE 'v1' END AS feed_hash, 'new' || s_suppkey || '.com' AS fqdn FROM supplier WHERE s_nationkey % 5 <> 0",
}


@query(
    "s13_sync_feeds",
    "SELECT feed, feed_hash, fqdn FROM cur WHERE feed IN ('f0', 'f2') UNION SELECT feed, feed_hash, fqdn FROM inc WHERE feed IN ('f1', 'f4')",
    _SYNC,
)
def sync_feeds(spark, d):
    s = ad.table(spark, d, "supplier")
    row = lambda n, mark, version: s.select(
        F.concat(F.lit("f"), (F.col("s_nationkey") % n).cast("string")).alias("feed"),
        version.alias("feed_hash"),
        F.lit("").alias("ip"),
        F.concat(F.lit(mark), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("fqdn"),
    )
    current = row(4, "old", F.lit("v1"))
    incoming = row(5, "new", F.when((F.col("s_nationkey") % 5).isin(1, 4), "v2").otherwise("v1")).filter("feed <> 'f0'")
    configured = spark.createDataFrame([(f"f{i}",) for i in (0, 1, 2, 4)], "feed string")
    return reference.sync_feeds(current, incoming, configured).select("feed", "feed_hash", "fqdn")


@query(
    "s14_read_valid_mime",
    "SELECT 'app/' || p AS mime_type, unnest(CASE WHEN g = 0 THEN [''] ELSE ['e' || p, 'x' || g] END) AS extension FROM (SELECT p_partkey AS p, p_partkey % 7 AS g FROM part)",
)
def valid_mime(spark, d):
    p = F.col("p_partkey")
    ext = F.when(p % 7 == 0, "none").otherwise(F.concat(F.lit(".e"), p.cast("string"), F.lit(", .x"), (p % 7).cast("string")))
    rows = ad.table(spark, d, "part").select(
        p.alias("name"), F.concat(F.lit("app/"), p.cast("string")).alias("mime"), ext.alias("extensions"), F.lit("ref").alias("reference")
    )
    path = fresh_path(spark, "mime")
    rows.write.option("header", True).csv(path)
    return reference.read_valid_mime(spark, path)


@query(
    "s15_read_scan_notices",
    "SELECT event_id AS n, CASE event_type WHEN 'view' THEN 'Scan::Port_Scan' ELSE 'Scan::Address_Scan' END AS note, '10.0.0.' || (user_id % 8) AS src FROM events WHERE event_type IN ('view', 'click')",
)
def scan_notices(spark, d):
    kind = F.col("event_type")
    note = F.when(kind == "view", "Scan::Port_Scan").when(kind == "click", "Scan::Address_Scan").otherwise("Weak::Key")
    line = F.to_json(
        F.struct(
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), note.alias("note"),
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string")).alias("src"), F.col("event_id").alias("n"), F.array(F.lit("log")).alias("actions"),
        )
    )
    return reference.read_scan_notices(spark, _written(ad.table(spark, d, "events").select(line.alias("value")), "notices")).select("n", "note", "src")


@query("s16_read_ja3_blacklist", "SELECT md5(p_name) AS hash, 'fam' || min(p_partkey % 5) AS family FROM part GROUP BY 1")
def ja3_blacklist(spark, d):
    p = ad.table(spark, d, "part").groupBy("p_name").agg(F.min(F.col("p_partkey") % 5).alias("g"))
    entry = F.concat(F.lit('"'), F.upper(F.md5("p_name")), F.lit('": {"family": "fam'), F.col("g").cast("string"), F.lit('", "threat": "t"}'))
    document = F.concat(F.lit('{"_comment": {"family": "x"}, '), entry, F.lit("}"))
    path = fresh_path(spark, "ja3")
    p.select(document.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return reference.read_ja3_blacklist(spark, path).select("hash", "family")


@query("s18_read_wordlist", "SELECT DISTINCT lower(trim(p_name)) AS word FROM part WHERE length(trim(p_name)) >= 3")
def wordlist(spark, d):
    return reference.read_wordlist(spark, _written(ad.table(spark, d, "part").select(F.col("p_name").alias("value")), "words"))


@query("s19_read_labeled_domains", "SELECT 'd' || s_suppkey || '.com' AS domain, CAST(s_acctbal < 0 AS INTEGER) AS label01 FROM supplier")
def labeled(spark, d):
    rows = ad.table(spark, d, "supplier").select(
        F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("domain"), F.when(F.col("s_acctbal") < 0, "DGA").otherwise("benign").alias("ground_truth")
    )
    path = fresh_path(spark, "labeled")
    rows.write.json(path)
    return spark.read.schema("domain string, ground_truth string").json(path).select("domain", (F.lower("ground_truth") == "dga").cast("int").alias("label01"))


@query(
    "s20_write_features",
    "SELECT count(*) AS rows, round(avg(orig_bytes), 6) AS mean_orig_bytes, round(avg(duration), 6) AS mean_duration FROM conn_events",
)
def write_features(spark, d):
    f = prepare_features(flow.flow_features(ad.conn_events(spark, d)))
    return store.write_features(f, fresh_path(spark, "features")).select("rows", "mean_orig_bytes", "mean_duration")


@query(
    "s21_upsert_alerts",
    """SELECT alert_id, CASE WHEN threat_class IN ('beaconing', 'dga_dns') THEN 'critical' ELSE severity END AS severity, CASE WHEN threat_class = 'dga_dns' THEN 0.5 ELSE confidence END AS confidence,
      CASE WHEN threat_class = 'dga_dns' THEN 'new' ELSE detector END AS detector FROM stored""",
)
def upsert(spark, d):
    s = stored(spark, d)
    base = s.filter("threat_class <> 'dga_dns'")
    incoming = (
        s.filter(F.col("threat_class").isin("beaconing", "dga_dns"))
        .withColumn("severity", F.lit("critical"))
        .withColumn("confidence", F.lit(0.5))
        .withColumn("detector", F.lit("new"))
    )
    return store.upsert_alerts(base, incoming).select("alert_id", "severity", "confidence", "detector")


_NEW = "threat_class IN ('beaconing', 'dga_dns')"


@query(
    "s21_upsert_lists",
    f"""SELECT alert_id, CASE WHEN {_NEW} THEN 'capture_9' ELSE pcap_id END AS pcap_id, list, item FROM (
      SELECT *, 'raw_alert_ids' AS list, unnest(CASE WHEN {_NEW} THEN [source || '_a', source || '_b'] ELSE [destination] END) AS item FROM stored
      UNION ALL SELECT *, 'correlated_ids' AS list, correlation_id AS item FROM stored WHERE correlation_id IS NOT NULL AND threat_class <> 'beaconing')""",
)
def upsert_lists(spark, d):
    """Two upserts: the second moves beacons to another capture with new raw ids and no peers."""
    s = stored(spark, d)
    path = fresh_path(spark, "alert-store")
    raw = lambda df, *items: df.select("alert_id", F.lit("raw_alert_ids").alias("list"), F.explode(F.array(*items)).alias("item"))
    peers = s.where("correlation_id IS NOT NULL").select("alert_id", F.lit("correlated_ids").alias("list"), F.col("correlation_id").alias("item"))
    first = s.where("threat_class <> 'dga_dns'")
    store.upsert_with_lists(spark, path, first, raw(first, "destination").union(peers))
    new = s.where(_NEW).withColumn("pcap_id", F.lit("capture_9"))
    mine = peers.join(new.where("threat_class = 'dga_dns'"), "alert_id", "left_semi")
    second = raw(new, F.concat("source", F.lit("_a")), F.concat("source", F.lit("_b"))).union(mine)
    store.upsert_with_lists(spark, path, new, second)
    alerts, lists = store.read_alerts(spark, path, s.schema)
    return lists.join(alerts.select("alert_id", "pcap_id"), "alert_id").select("alert_id", "pcap_id", "list", "item")


@query("s22_delete_scope", "SELECT alert_id, pcap_id FROM stored WHERE pcap_id IS NULL OR pcap_id <> 'capture_1'")
def delete(spark, d):
    return store.delete_scope(stored(spark, d), "capture_1").select("alert_id", "pcap_id")


@query(
    "s22_overwrite_partitions",
    "SELECT coalesce(pcap_id, 'none') AS pcap_id, count(*) FILTER (pcap_id IS DISTINCT FROM 'capture_1' OR severity = 'high') AS alerts FROM stored GROUP BY 1",
)
def overwrite(spark, d):
    path = fresh_path(spark, "alerts")
    s = stored(spark, d).withColumn("pcap_id", F.coalesce("pcap_id", F.lit("none"))).select("alert_id", "severity", "pcap_id")
    s.write.partitionBy("pcap_id").parquet(path)
    store.overwrite_partitions(s.filter("pcap_id = 'capture_1' AND severity = 'high'"), path)
    return spark.read.parquet(path).groupBy("pcap_id").agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "s23_upsert_analysis",
    """SELECT CAST(o_custkey AS VARCHAR) AS pcap_id, CASE WHEN max(o_orderstatus) = 'P' THEN 'complete' ELSE 'running' END AS status, count(*) AS connections FROM orders GROUP BY o_custkey""",
)
def analysis(spark, d):
    o = ad.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("pcap_id")).agg(
        F.count(F.lit(1)).alias("connections"), F.max("o_orderstatus").alias("_s")
    )
    base = o.select("pcap_id", F.lit("running").alias("status"), "connections")
    done = o.filter("_s = 'P'").select("pcap_id", F.lit("complete").alias("status"))
    return store.upsert_analysis(base, done)


@query(
    "s24_retention",
    "SELECT uid FROM conn_events WHERE ts >= (SELECT max(ts) FROM conn_events) - INTERVAL 26 HOUR",
)
def retention(spark, d):
    c = ad.conn_events(spark, d)
    newest = c.agg(F.max("ts").alias("_now"))
    return store.apply_retention(c.crossJoin(F.broadcast(newest)), "ts", "26 HOURS", F.col("_now")).select("uid")


def _lifetimes_sql() -> str:
    def part(kind: str, keep: int, unit: int) -> str:
        limit = f"(SELECT epoch(max(ts))::BIGINT - {keep} FROM conn_events)"
        return f"""SELECT '{kind}' AS kind, count(*) FILTER (epoch_us(ts) >= {limit} * 1000000) AS rows,
          count(DISTINCT slot) FILTER ((slot + 1) * {unit} <= {limit}) AS dropped
          FROM (SELECT ts, epoch(date_trunc('second', ts))::BIGINT // {unit} AS slot FROM conn_events)"""

    return " UNION ALL ".join(part(kind, *spans) for kind, spans in store.LIFETIMES.items())


@query("s24_drop_expired", _lifetimes_sql())
def drop_expired(spark, d):
    """A table of each lifetime, filed by time: rows left and partitions dropped at the newest record's time."""
    c = ad.conn_events(spark, d).select("uid", "ts")
    # The newest record's time in whole seconds, rounded like the SQL's.
    now = c.agg(F.rint(F.unix_micros(F.max("ts")) / 1_000_000).cast("bigint")).first()[0]
    found = None
    for kind, (keep, unit) in store.LIFETIMES.items():
        path = fresh_path(spark, f"filed-{kind}")
        store.write_by_time(c, path, "ts", unit)
        done = store.drop_expired(spark, path, "ts", keep, unit, now or 0)
        left = spark.read.schema(c.schema).parquet(path).agg(F.count(F.lit(1)).alias("rows"))
        row = left.select(F.lit(kind).alias("kind"), "rows", F.lit(done["dropped"]).cast("bigint").alias("dropped"))
        found = row if found is None else found.unionByName(row)
    return found


@query(
    "s25_write_alerts_json",
    "SELECT threat_class, detector, count(*) AS alerts, max(confidence) AS max_confidence FROM stored GROUP BY ALL",
)
def alerts_json(spark, d):
    return store.write_alerts_json(stored(spark, d), fresh_path(spark, "alerts-json"))


_DATASETS = {
    "imports": "SELECT o_orderpriority AS dataset, o_orderstatus = 'P' AS rolling, o_orderdate AS min_ts, o_orderdate + to_seconds(o_orderkey) AS max_ts FROM orders",
}


@query(
    "a39_list_datasets",
    """SELECT dataset, rolling, epoch(greatest(min(min_ts), max(max_ts) - INTERVAL 14 DAY))::BIGINT AS min_ts, epoch(max(max_ts))::BIGINT AS max_ts FROM imports GROUP BY ALL""",
    _DATASETS,
)
def datasets(spark, d):
    return store.list_datasets(_imports(spark, d)).select("dataset", "rolling", *secs("min_ts", "max_ts"))


def _imports(spark, d):
    start = F.col("o_orderdate").cast("timestamp")
    return ad.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("dataset"), (F.col("o_orderstatus") == "P").alias("rolling"), start.alias("min_ts"),
        F.timestamp_seconds(F.unix_seconds(start) + F.col("o_orderkey")).alias("max_ts"),
    )


@query("j19_sample_flags", "SELECT dataset, rolling, dataset IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 499900) AS is_sample FROM imports GROUP BY ALL", _DATASETS)
def sample_flags(spark, d):
    samples = ad.table(spark, d, "orders").filter("o_totalprice > 499900").select(F.col("o_orderpriority").alias("dataset"))
    return store.with_sample_flag(store.list_datasets(_imports(spark, d)), samples).select("dataset", "rolling", "is_sample")
