"""Queries over detectors: floods, TLS sessions, domain features, the combined run."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.config import ExfilConfig, FloodConfig, ScanConfig
from wiretally.operators import alerts as contract
from wiretally.operators import analytics, dga, exfil, floods, flow, scan, tls
from wiretally.operators.hourly import union_all
from wiretally.operators.runner import run_detectors
from wiretally.plans import adapters as ad
from wiretally.plans.q_flow import _S, _SYN, _SYN_ACK, W, _probing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = ad.sql(oracle, extra)
        return function

    return register


# ---- floods ------------------------------------------------------------------------

FLOOD = FloodConfig(window_seconds=W, z_threshold=1.5, entropy_z_threshold=0.5)

_WINDOWS = f"""SELECT a.*, ent, srcs, row_number() OVER (PARTITION BY a.dst ORDER BY a.w) AS rn FROM (
    SELECT w, dst, count(*) AS flows, sum(orig_pkts + resp_pkts) / {W}.0 AS pr, sum(orig_ip_bytes + resp_ip_bytes) / {W}.0 AS br,
      count(*) FILTER (proto = 'tcp') AS tcp, count(*) FILTER (proto = 'udp') AS udp, count(*) FILTER ({_SYN}) AS syn, min(src) AS one,
      sum(resp_ip_bytes) AS rb, sum(orig_ip_bytes) AS ob
    FROM (SELECT *, {ad.sec('ts')} // {W} * {W} AS w FROM conn_events) GROUP BY ALL) a
  JOIN (SELECT w, dst, count(*) AS srcs, CASE WHEN count(*) <= 1 THEN 0.0 ELSE greatest(0.0, log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) / sum(n)) END AS ent
    FROM (SELECT {ad.sec('ts')} // {W} * {W} AS w, dst, src, count(*) AS n FROM conn_events GROUP BY ALL) GROUP BY ALL) b ON a.w = b.w AND a.dst = b.dst"""


def _flood_sql(body: str, z: float = 1.5, ez: float = 0.5) -> str:
    """Window by window per destination; a flagged window is not learned."""
    head = ad.sql("SELECT 1 FROM conn_events")[len("WITH ") : -len("\nSELECT 1 FROM conn_events")]
    score = lambda value, past: f"({value} - list_aggregate({past}, 'avg')) / greatest(list_aggregate({past}, 'stddev_pop'), 1e-9)"
    return f"""WITH RECURSIVE {head}, win AS MATERIALIZED ({_WINDOWS}),
    run AS (
      SELECT DISTINCT dst, 0::BIGINT AS rn, []::DOUBLE[] AS p, []::DOUBLE[] AS b, []::DOUBLE[] AS e, 0::BIGINT AS size, NULL::DOUBLE AS pz, NULL::DOUBLE AS bz, NULL::DOUBLE AS ez, false AS fl FROM win
      UNION ALL
      SELECT dst, rn, CASE WHEN f THEN p ELSE list_append(p, pr)[-30:] END, CASE WHEN f THEN b ELSE list_append(b, br)[-30:] END,
        CASE WHEN f THEN e ELSE list_append(e, ent)[-30:] END, size, pz, bz, ez, f
      FROM (SELECT *, coalesce(greatest(pz, bz) >= {z} AND abs(ez) >= {ez}, false) AS f FROM (
        SELECT w.dst, w.rn, pr, br, ent, r.p, r.b, r.e, len(r.p) AS size,
          CASE WHEN flows >= 5 AND len(r.p) >= 2 THEN {score('pr', 'r.p')} END AS pz,
          CASE WHEN flows >= 5 AND len(r.p) >= 2 THEN {score('br', 'r.b')} END AS bz,
          CASE WHEN flows >= 5 AND len(r.p) >= 2 THEN {score('ent', 'r.e')} END AS ez
        FROM run r JOIN win w ON w.dst = r.dst AND w.rn = r.rn + 1)))
    {body}"""


def _windows(spark, d):
    return flow.flow_windows(ad.conn_events(spark, d), W)


@query("d01_flood_scores")
def flood_scores(spark, d):
    s = floods.score_windows(_windows(spark, d), FLOOD)
    z = [F.round(c, 5).alias(c) for c in ("pkt_z", "byte_z", "entropy_z")]
    return s.select("dst", F.unix_seconds("window_start").alias("window_start"), F.col("baseline_size").cast("bigint").alias("baseline_size"), "flagged", *z)


ORACLES["d01_flood_scores"] = _flood_sql(
    """SELECT r.dst, w AS window_start, size AS baseline_size, fl AS flagged, round(pz, 5) AS pkt_z, round(bz, 5) AS byte_z, round(ez, 5) AS entropy_z
    FROM run r JOIN win ON win.dst = r.dst AND win.rn = r.rn"""
)

_SUBTYPE = """CASE WHEN tcp > 0 AND syn / tcp >= 0.8 THEN 'syn_flood' WHEN udp / flows >= 0.8 AND srcs >= 10 AND ob > 0 AND rb / ob >= 3 THEN 'reflection_amplification_like'
    WHEN udp / flows >= 0.8 THEN 'udp_flood' WHEN srcs >= 20 THEN 'spoofing_like' ELSE 'volumetric_generic' END"""


@query("d02_detect_floods")
def detect_floods(spark, d):
    f = floods.detect_floods(_windows(spark, d), FLOOD)
    return f.select("flow_id", "dst", "source", "subtype", "severity", F.round("confidence", 5).alias("confidence"), "entropy_change")


ORACLES["d02_detect_floods"] = _flood_sql(
    f"""SELECT 'w_' || r.dst || '_' || w || '_' || (w + {W}) AS flow_id, r.dst, CASE WHEN srcs = 1 THEN one ELSE 'multiple' END AS source, {_SUBTYPE} AS subtype,
      CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS severity, round(c, 5) AS confidence,
      CASE WHEN ez < 0 THEN 'drop' ELSE 'spike' END AS entropy_change
    FROM (SELECT *, least(greatest(greatest(pz, bz) / 3.0, 0), 1)::DOUBLE AS c FROM run WHERE fl) r JOIN win ON win.dst = r.dst AND win.rn = r.rn"""
)
QUERIES["w03_rolling_baseline"] = QUERIES["d01_flood_scores"]
ORACLES["w03_rolling_baseline"] = ORACLES["d01_flood_scores"]


@query(
    "d03_flood_confidence",
    """SELECT event_id, least(greatest(greatest(value / 20, value / 40) / 8, 0), 1)::DOUBLE AS confidence,
      CASE WHEN least(greatest(greatest(value / 20, value / 40) / 8, 0), 1) >= 0.8 THEN 'high' WHEN least(greatest(greatest(value / 20, value / 40) / 8, 0), 1) >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM events""",
)
def flood_confidence(spark, d):
    e = ad.table(spark, d, "events").withColumn("pkt_z", F.col("value") / 20).withColumn("byte_z", F.col("value") / 40)
    c = floods.flood_confidence()
    return e.select("event_id", c.alias("confidence"), floods.flood_severity(c).alias("severity"))


# ---- TLS ---------------------------------------------------------------------------

_RATIO = "orig_bytes / CASE WHEN resp_bytes > 0 THEN resp_bytes ELSE 0.000001 END"
_SIZE = "(orig_bytes + resp_bytes) / greatest(orig_pkts + resp_pkts, 1)"
# Halves are rounded to even on the decimal value, as the operator does.
_EVEN4 = "round_even({0}, 4)"
_T = {
    "sessions": f"""SELECT s.uid, s.server_name, s.ja3, s.ja3s, c.src, c.dst, c.orig_bytes, c.resp_bytes, c.orig_pkts, c.resp_pkts, c.duration FROM ssl_orders s JOIN conn_orders c ON s.uid = c.uid""",
    "tlsf": f"""SELECT *, {_EVEN4.format(_SIZE)} AS mean_packet_size, {_EVEN4.format(_RATIO)} AS byte_ratio, orig_pkts + resp_pkts AS packet_count FROM sessions""",
    "blacklist": "SELECT md5(o_orderpriority) AS hash, 'family-' || substr(min(o_orderpriority), 1, 1) AS family FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "tlss": """SELECT t.*, b.family AS ja3_family, round_even(r / (1 + r), 4) AS behavior_score FROM (SELECT *, 0.6 * greatest(0, (byte_ratio - 2) / 2) + 0.4 * greatest(0, (mean_packet_size - 360) / 300) AS r FROM tlsf) t
      LEFT JOIN blacklist b ON b.hash = t.ja3""",
    "tlsst": """SELECT *, CASE WHEN ja3_family IS NOT NULL AND behavior_score >= 0.45 THEN 'both' WHEN ja3_family IS NOT NULL THEN 'fingerprint_only'
      WHEN behavior_score >= 0.45 THEN 'behavior_only' ELSE 'none' END AS fusion_state FROM tlss""",
}


def blacklist(spark, d):
    o = ad.table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.groupBy(F.md5("o_orderpriority").alias("hash")).agg(
        F.concat(F.lit("family-"), F.substring(F.min("o_orderpriority"), 1, 1)).alias("family"), F.lit("malware").alias("threat")
    )


def _features(spark, d):
    conn = ad.conn_orders(spark, d).drop("src", "dst", "src_port", "dst_port")
    return tls.tls_features(tls.join_ssl_conn(ad.ssl_orders(spark, d), conn))


def _scored(spark, d):
    from wiretally.config import TlsConfig

    return tls.score_tls(_features(spark, d), blacklist(spark, d), TlsConfig(threshold=0.45))


@query("p19_tls_features", "SELECT uid, round(mean_packet_size, 3) AS mean_packet_size, round(byte_ratio, 3) AS byte_ratio, packet_count, duration FROM tlsf", _T)
def tls_features(spark, d):
    f = _features(spark, d)
    return f.select("uid", F.round("mean_packet_size", 3).alias("mean_packet_size"), F.round("byte_ratio", 3).alias("byte_ratio"), "packet_count", "duration")


@query("d06_tls_behavior_score", "SELECT uid, round(behavior_score, 3) AS behavior_score FROM tlss", _T)
def behavior(spark, d):
    return _scored(spark, d).select("uid", F.round("behavior_score", 3).alias("behavior_score"))


@query("j17_match_ja3", "SELECT uid, ja3_family, ja3_family IS NOT NULL AS fingerprint_match FROM tlss", _T)
def match_ja3(spark, d):
    return tls.match_ja3(_features(spark, d), blacklist(spark, d)).select("uid", "ja3_family", "fingerprint_match")


@query(
    "d07_detect_tls",
    """SELECT uid, fusion_state, CASE fusion_state WHEN 'both' THEN 0.9 WHEN 'fingerprint_only' THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence,
      CASE fusion_state WHEN 'both' THEN 'high' ELSE 'medium' END AS severity,
      CASE fusion_state WHEN 'both' THEN 'encrypted_malware' WHEN 'fingerprint_only' THEN 'suspicious_fingerprint' ELSE 'tls_behavioral_anomaly' END AS subtype
    FROM tlsst WHERE fusion_state <> 'none'""",
    _T,
)
def detect_tls(spark, d):
    return _scored(spark, d).filter(F.col("fusion_state") != "none").select("uid", "fusion_state", "confidence", "severity", "subtype")


@query(
    "a46_tls_state_counts",
    "SELECT server_name AS dataset, fusion_state, count(*) AS sessions, round(avg(behavior_score), 6) AS mean_behavior_score FROM tlsst GROUP BY ALL",
    _T,
)
def state_counts(spark, d):
    s = tls.state_counts(_scored(spark, d).withColumn("dataset", F.col("server_name")))
    return s.withColumn("mean_behavior_score", F.round("mean_behavior_score", 6))


# ---- domain features ---------------------------------------------------------------

_D = {
    # Host labels, supplier-derived digests and the words of part names as labels.
    "dga_labels": """SELECT DISTINCT label FROM (SELECT lower(split_part(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.', 1)) AS label FROM pages
      UNION ALL SELECT substr(md5(s_name), 1, 8 + CAST(s_suppkey % 9 AS INTEGER)) FROM supplier UNION ALL SELECT lower(c_mktsegment) FROM customer) WHERE label <> ''""",
    "dga_words": """SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) >= 3""",
    "chars": "SELECT label, unnest(string_split(label, '')) AS c FROM dga_labels",
    "char_entropy": """SELECT label, CASE WHEN sum(n) <= 1 THEN 0.0 ELSE round(log2(sum(n)::DOUBLE) - sum(n * log2(n)) / sum(n), 6) END AS label_entropy
      FROM (SELECT label, c, count(*) AS n FROM chars WHERE c <> '' GROUP BY ALL) GROUP BY label""",
    "vc": "SELECT label, len(regexp_extract_all(label, '[aeiou]')) AS v, len(regexp_extract_all(label, '[bcdfghjklmnpqrstvwxyz]')) AS k, len(regexp_extract_all(label, '[0-9]')) AS g FROM dga_labels",
    "pieces": """SELECT DISTINCT label, substr(label, a, k) AS piece FROM (SELECT label, unnest(range(1, length(label) + 1)) AS a FROM dga_labels) p
      CROSS JOIN (SELECT unnest(range(3, 64)) AS k) q WHERE a + k - 1 <= length(label)""",
    "word_bigrams": "SELECT substr(word, i, 2) AS bigram, count(*) AS n FROM (SELECT word, unnest(range(1, length(word))) AS i FROM dga_words) GROUP BY 1",
    "bigram_model": "SELECT bigram, log10((n + 1) / (SELECT sum(n) + count(*) FROM word_bigrams)) AS log10_p FROM word_bigrams",
    "cleaned": "SELECT label, regexp_replace(label, '[^a-z0-9_-]', '', 'g') AS clean FROM dga_labels",
}


def labels(spark, d):
    hosts = ad.dns_pages(spark, d).select(F.col("query").alias("domain"))
    made = ad.table(spark, d, "supplier").select(
        F.substring(F.md5("s_name"), F.lit(1), (F.lit(8) + F.col("s_suppkey") % 9).cast("int")).alias("domain")
    )
    words = ad.table(spark, d, "customer").select(F.col("c_mktsegment").alias("domain"))
    return dga.labels_of(hosts.union(made).union(words))


def words(spark, d):
    text = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    w = ad.table(spark, d, "documents").select(F.explode(text).alias("word"))
    return w.filter(F.length("word") >= dga.MIN_WORD).distinct()


@query(
    "d12_dga_features",
    """SELECT l.label, length(l.label)::DOUBLE AS label_length, label_entropy, round(g / length(l.label), 6) AS digit_ratio,
      CASE WHEN k > 0 THEN round(v / k, 6) ELSE v::DOUBLE END AS vowel_consonant_ratio FROM dga_labels l JOIN char_entropy USING (label) JOIN vc USING (label)""",
    _D,
)
def dga_features(spark, d):
    return dga.lexical_features(labels(spark, d))


@query(
    "d13_longest_word_ratio",
    "SELECT l.label, round(coalesce(m, 0) / length(l.label), 6) AS longest_word_ratio FROM dga_labels l LEFT JOIN (SELECT label, max(length(piece)) AS m FROM pieces JOIN dga_words ON word = piece GROUP BY label) p USING (label)",
    _D,
)
def longest_word(spark, d):
    return dga.longest_word_ratio(labels(spark, d), words(spark, d))


@query("d14_fit_bigrams", "SELECT bigram, round(log10_p, 6) AS log10_p FROM bigram_model", _D)
def fit_bigrams(spark, d):
    return dga.fit_bigrams(words(spark, d)).withColumn("log10_p", F.round("log10_p", 6))


@query(
    "d14_bigram_distance",
    """SELECT l.label, coalesce(x, 0.0) AS bigram_distance FROM dga_labels l LEFT JOIN (SELECT label, round(-avg(coalesce(log10_p, -4.5)), 6) AS x
      FROM (SELECT label, substr(clean, i, 2) AS bigram FROM (SELECT label, clean, unnest(range(1, length(clean))) AS i FROM cleaned)) b LEFT JOIN bigram_model USING (bigram) GROUP BY label) q USING (label)""",
    _D,
)
def bigram_distance(spark, d):
    return dga.bigram_distance(labels(spark, d), dga.fit_bigrams(words(spark, d)))


# ---- combined run ------------------------------------------------------------------


def _flood_alerts(spark, d):
    flood = floods.detect_floods(flow.flow_windows(ad.conn_events(spark, d), W), FLOOD)
    flood = flood.withColumn("destination", F.col("dst")).withColumn("ts", F.col("window_start"))
    return contract.make_alerts(flood, "ddos", "flood_windows", ["flow_count", "pkt_z", "byte_z", "entropy_z"])


def _leak_alerts(spark, d):
    cfg = ExfilConfig(window_seconds=W, volume_floor=5_000)
    out = exfil.exfil_windows(exfil.outbound_only(ad.conn_events(spark, d), cfg), W)
    leak = (
        exfil.detect_exfil(out, exfil.host_baseline(out), cfg)
        .withColumn("source", F.col("src"))
        .withColumn("destination", F.col("dst"))
        .withColumn("ts", F.col("window_start"))
    )
    return contract.make_alerts(leak, "exfiltration", "outbound_ratio", ["outbound_bytes", "inbound_bytes", "byte_ratio"])


def _tls_alerts(spark, d):
    bad = _scored(spark, d).filter(F.col("fusion_state") != "none").withColumn("source", F.col("src")).withColumn("destination", F.col("dst"))
    bad = bad.withColumn("flow_id", F.concat(F.lit("tls_"), F.col("uid")))
    return contract.make_alerts(bad, "tls_anomaly", "tls_sessions", ["ja3", "behavior_score", "fusion_state"])


def _scan_alerts(spark, d):
    probes = scan.detect_port_scan(_probing(spark, d), ScanConfig(hosts=3, ports=4, window="1 day")).select(
        F.col("window_start").alias("ts"),
        F.col("scanner").alias("source"),
        F.col("victim").alias("destination"),
        F.lit("port_scan").alias("subtype"),
        F.lit("high").alias("severity"),
        F.lit(0.95).alias("confidence"),
        "distinct_probes",
    )
    return contract.make_alerts(probes, "reconnaissance", "connection_scans", ["distinct_probes"])


def _dga_alerts(spark, d):
    from wiretally.plans import q_models

    return contract.make_alerts(q_models.dga_findings(spark, d), "dga", "generated_domains", ["query", "probability_dga"])


def detectors(spark, d):
    """Every detector by name; only the model of generated domains has no equal in SQL."""
    from wiretally.plans import q_scores

    made = {
        "flood_windows": _flood_alerts,
        "outbound_ratio": _leak_alerts,
        "tls_sessions": _tls_alerts,
        "connection_scans": _scan_alerts,
        "pair_beacons": q_scores.made_beacon_alerts,
        "dns_tunnels": q_scores.made_tunnel_alerts,
        "generated_domains": _dga_alerts,
    }
    return {name: lambda make=make: make(spark, d) for name, make in made.items()}


_RUN = {**_S, **_T}


@query("f08_run_all")
def run_all(spark, d):
    """Valid alerts of the detectors that follow fixed rules, counted."""
    fixed = {name: make for name, make in detectors(spark, d).items() if name != "generated_domains"}
    valid, _ = contract.validate_alerts(union_all([make() for make in fixed.values()]))
    return valid.groupBy("threat_class", "detector", "severity").agg(F.count(F.lit(1)).alias("alerts"))


@query("f08_run_all_detectors")
def run_all_detectors(spark, d):
    """Valid alerts of all seven detectors in one run, the learned one among them, counted."""
    made, _ = run_detectors(spark, detectors(spark, d))
    valid, _ = contract.validate_alerts(made)
    return valid.groupBy("threat_class", "detector", "severity").agg(F.count(F.lit(1)).alias("alerts"))


@query("f08_detector_status")
def detector_status(spark, d):
    """How all detectors fared; the number of alerts of the learned one is left out."""
    _, status = run_detectors(spark, detectors(spark, d))
    fixed = F.when(F.col("detector") != "generated_domains", F.col("alerts"))
    return status.select("detector", "status", "error", fixed.alias("alerts"))


def _run_all_sql() -> str:
    flood = _flood_sql(
        """SELECT 'ddos' AS threat_class, 'flood_windows' AS detector, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS severity, count(*) AS alerts
        FROM (SELECT least(greatest(greatest(pz, bz) / 3.0, 0), 1)::DOUBLE AS c FROM run WHERE fl) GROUP BY ALL"""
    )
    from wiretally.plans.q_flow import _DETECT, _E

    leak = ad.sql(
        f"SELECT 'exfiltration' AS threat_class, 'outbound_ratio' AS detector, severity, count(*) AS alerts FROM ({_DETECT.format(floor=5000).replace('/ 50000', '/ 5000')}) q GROUP BY ALL", _E
    )
    bad = ad.sql(
        "SELECT 'tls_anomaly' AS threat_class, 'tls_sessions' AS detector, CASE fusion_state WHEN 'both' THEN 'high' ELSE 'medium' END AS severity, count(*) AS alerts FROM tlsst WHERE fusion_state <> 'none' GROUP BY ALL", _T
    )
    probes = ad.sql(
        "SELECT 'reconnaissance' AS threat_class, 'connection_scans' AS detector, 'high' AS severity, count(*) AS alerts FROM (SELECT w, scanner, victim FROM roles GROUP BY ALL HAVING count(DISTINCT probed_port) >= 4) GROUP BY ALL", _S
    )
    from wiretally.plans.q_scores import _FOUND

    c2 = ad.sql(
        "SELECT 'beaconing' AS threat_class, 'pair_beacons' AS detector, severity, count(*) AS alerts FROM typed WHERE NOT strobe AND bs >= 0.75 GROUP BY ALL", _FOUND
    )
    tunnels = ad.sql(
        "SELECT 'dns_tunnel' AS threat_class, 'dns_tunnels' AS detector, CASE sev WHEN 'High' THEN 'high' WHEN 'None' THEN 'info' ELSE 'medium' END AS severity, count(*) AS alerts FROM raw_found WHERE TRY_CAST(c2 AS DOUBLE) > 0 GROUP BY ALL", _FOUND
    )
    return " UNION ALL ".join(f"SELECT * FROM ({part})" for part in (flood, leak, bad, probes, c2, tunnels))


ORACLES["f08_run_all"] = _run_all_sql()
ORACLES["f08_detector_status"] = f"""SELECT detector, 'ok' AS status, '' AS error, CASE WHEN detector <> 'generated_domains' THEN coalesce(alerts, 0) END AS alerts
  FROM (SELECT unnest(['flood_windows', 'outbound_ratio', 'tls_sessions', 'connection_scans', 'pair_beacons', 'dns_tunnels', 'generated_domains']) AS detector)
  LEFT JOIN (SELECT detector, CAST(sum(alerts) AS BIGINT) AS alerts FROM ({ORACLES["f08_run_all"]}) GROUP BY detector) USING (detector)"""
