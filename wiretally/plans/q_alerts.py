"""Queries over alerts: contract, correlation, fusion, analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions.formats import THREAT_ALIASES, THREAT_LABELS
from wiretally.operators import alerts as contract
from wiretally.operators import analytics as an
from wiretally.operators import fusion
from wiretally.operators.correlate import correlate, correlation_groups
from wiretally.plans.adapters import alerts_events, assets, sec, sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = sql(oracle, {**_COMMON, **(extra or {})})
        return function

    return register


_LABEL = (
    "CASE threat_class "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in THREAT_LABELS.items())
    + " ".join(f" WHEN '{a}' THEN '{THREAT_LABELS[k]}'" for a, k in THREAT_ALIASES.items())
    + " ELSE threat_class END"
)

_MICROS = "epoch_us(ts)"

# Greedy anchor walk per source as a recursion over anchors. opens: times whose 300 s
# window holds two classes.
_COMMON = {
    "cells": f"SELECT DISTINCT source, {_MICROS} AS t, threat_class AS cls FROM alerts_events",
    "reach": """SELECT source, t, min(t2) AS other FROM (
        SELECT a.source, a.t, b.t AS t2 FROM cells a JOIN cells b
          ON a.source = b.source AND b.t >= a.t AND b.t <= a.t + 300000000 AND b.cls <> a.cls) GROUP BY ALL""",
    "openers": "SELECT DISTINCT source, t FROM reach",
    "hops": """SELECT o.source, o.t, (SELECT min(n.t) FROM openers n WHERE n.source = o.source AND n.t > o.t + 300000000) AS nxt
        FROM openers o""",
    "first_anchor": "SELECT source, min(t) AS t FROM openers GROUP BY source",
    "correlated": """SELECT a.*, w.t AS anchor FROM alerts_events a LEFT JOIN walk w
        ON a.source = w.source AND epoch_us(a.ts) BETWEEN w.t AND w.t + 300000000""",
}


def _recursive(body: str) -> str:
    """The walk needs a recursive CTE; all others stay plain."""
    text = sql(body, {**_COMMON, "walk": "SELECT 1"})
    step = """walk AS (
      SELECT source, t FROM first_anchor
      UNION ALL
      SELECT h.source, h.nxt FROM walk w JOIN hops h ON h.source = w.source AND h.t = w.t WHERE h.nxt IS NOT NULL)"""
    helper = sql("SELECT * FROM hops, first_anchor", _COMMON)
    head = helper[len("WITH ") : helper.rindex("\nSELECT * FROM hops")]
    rest = text[len("WITH ") :].replace("walk AS (SELECT 1)", "walk_unused AS (SELECT 1)")
    seen = {part.split(" AS (")[0].strip() for part in head.split(",\n") if " AS (" in part}
    body_parts = []
    for part in _split_ctes(rest[: rest.rindex("\n" + body)]):
        if part.split(" AS (")[0].strip() not in seen:
            body_parts.append(part)
    return "WITH RECURSIVE " + head + ",\n" + step + ",\n" + ",\n".join(body_parts) + "\n" + body


def _split_ctes(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += ch == "("
        depth -= ch == ")"
        if depth == 0 and text.startswith(",\n", i):
            parts.append(text[start:i])
            start = i + 2
    parts.append(text[start:])
    return parts


_UUID = """substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' ||
  translate(substr({h}, 17, 1), '01234567cdef', '89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""
_CID = _UUID.format(h="md5('incident|' || source || '|' || anchor)")


def stored(spark, d):
    """Alerts with incidents given by source and day, as a stored table would have them."""
    a = alerts_events(spark, d)
    incident = F.concat_ws("_", F.lit("inc"), "source", F.substring("timestamp", 1, 10))
    return a.withColumn("correlation_id", F.when(F.col("severity") != "info", incident)).withColumn(
        "asset_criticality",
        F.when(F.col("severity") == "critical", "critical").otherwise("standard"),
    )


_COMMON["stored"] = """SELECT *, CASE WHEN severity <> 'info' THEN 'inc_' || source || '_' || substr(timestamp, 1, 10) END AS correlation_id,
    CASE WHEN severity = 'critical' THEN 'critical' ELSE 'standard' END AS asset_criticality FROM alerts_events"""


@query(
    "f03_make_alerts",
    f"""SELECT {_UUID.format(h="md5('spikes|' || flow_id || '|' || replace(CAST(ts AS VARCHAR), 'T', ' '))")} AS alert_id,
      timestamp, flow_id, 'ddos' AS threat_class, severity, confidence, source, destination, '{{"value":"' || severity || '"}}' AS supporting_evidence,
      'spikes' AS detector, '1.0.0' AS model_version, '1.0.0' AS schema_version, '1.0.0' AS detector_version, 'periodic' AS latency_class
    FROM alerts_events""",
)
def make_alerts(spark, d):
    found = alerts_events(spark, d).withColumn("value", F.col("severity"))
    made = contract.make_alerts(found, "ddos", "spikes", ["value"])
    return made.select(
        "alert_id",
        F.regexp_replace("timestamp", "Z$", "+00:00").alias("timestamp"),
        *("flow_id", "threat_class", "severity", "confidence", "source", "destination", "supporting_evidence"),
        *("detector", "model_version", "schema_version", "detector_version", "latency_class"),
    )


def _damaged(spark, d):
    """Alerts with a rule broken per event kind and value band."""
    a = alerts_events(spark, d)
    cls = F.col("threat_class")
    return (
        a.withColumn("alert_id", F.when(cls == "beaconing", F.md5("alert_id")).otherwise(F.col("alert_id")))
        .withColumn(
            "timestamp",
            F.when(cls == "dga_dns", F.substring("timestamp", 1, 19)).otherwise(F.col("timestamp")),
        )
        .withColumn("confidence", F.when(F.col("severity") == "critical", F.lit(1.5)).otherwise(F.col("confidence")))
        .withColumn("supporting_evidence", F.when(F.col("severity") == "high", "{}").otherwise(F.col("supporting_evidence")))
        .withColumn("detector", F.when(F.col("severity") == "low", F.lit(None)).otherwise(F.col("detector")))
        .withColumn("threat_class", F.when(cls == "exfiltration", "leak").otherwise(cls))
    )


_ERRORS = """CASE WHEN severity = 'low' THEN 'missing:detector;' ELSE '' END
    || CASE WHEN threat_class = 'beaconing' THEN 'alert_id:not_uuid4;' ELSE '' END
    || CASE WHEN threat_class = 'dga_dns' THEN 'timestamp:invalid;' ELSE '' END
    || CASE WHEN severity = 'critical' THEN 'confidence:out_of_range;' ELSE '' END
    || CASE WHEN threat_class = 'exfiltration' THEN 'threat_class:unknown;' ELSE '' END
    || CASE WHEN severity = 'high' THEN 'evidence:empty;' ELSE '' END"""


@query("f04_validate_alerts_rejected", f"SELECT * FROM (SELECT flow_id, {_ERRORS} AS errors FROM alerts_events) WHERE errors <> ''")
def validate_rejected(spark, d):
    _, bad = contract.validate_alerts(_damaged(spark, d))
    return bad.select("flow_id", F.concat(F.array_join("errors", ";"), F.lit(";")).alias("errors"))


@query("f04_validate_alerts_valid", f"SELECT flow_id, alert_id FROM alerts_events WHERE {_ERRORS} = ''")
def validate_valid(spark, d):
    good, _ = contract.validate_alerts(_damaged(spark, d))
    return good.select("flow_id", "alert_id")


@query("w05_correlate")
def correlate_query(spark, d):
    c = correlate(alerts_events(spark, d))
    return c.select("alert_id", F.coalesce("correlation_id", F.lit("")).alias("correlation_id"))


ORACLES["w05_correlate"] = _recursive(f"SELECT alert_id, coalesce({_CID}, '') AS correlation_id FROM correlated")


@query("f05_correlation_groups")
def groups_query(spark, d):
    g = correlation_groups(correlate(alerts_events(spark, d)))
    return g.select(
        "correlation_id",
        "source",
        "alert_count",
        F.unix_micros("start_time").alias("start_us"),
        F.unix_micros("end_time").alias("end_us"),
        F.array_join("threat_classes", ",").alias("threat_classes"),
    )


ORACLES["f05_correlation_groups"] = _recursive(
    f"""SELECT {_CID} AS correlation_id, source, count(*) AS alert_count, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us,
      string_agg(DISTINCT threat_class, ',' ORDER BY threat_class) AS threat_classes
    FROM correlated WHERE anchor IS NOT NULL GROUP BY source, anchor"""
)

_CRIT = {
    "crit": "SELECT ip, max(criticality) FILTER (criticality = 'critical') AS c, max(criticality) FILTER (criticality = 'standard') AS s FROM assets GROUP BY ip",
}
_CRIT_EXPR = """CASE WHEN s1.c IS NOT NULL OR s2.c IS NOT NULL THEN 'critical'
    WHEN s1.s IS NOT NULL OR s2.s IS NOT NULL THEN 'standard' ELSE 'unknown' END"""


@query(
    "j16_resolve_criticality",
    f"""SELECT alert_id, {_CRIT_EXPR} AS asset_criticality FROM alerts_events a
    LEFT JOIN crit s1 ON a.source = s1.ip LEFT JOIN crit s2 ON a.destination = s2.ip""",
    _CRIT,
)
def criticality_query(spark, d):
    return fusion.resolve_criticality(alerts_events(spark, d), assets(spark, d)).select("alert_id", "asset_criticality")


_RANK = "CASE WHEN threat_class IN ('reconnaissance', 'scanning') THEN 1 WHEN threat_class IN ('ddos', 'dns_tunnel', 'exfiltration') THEN 3 ELSE 2 END"


def _ladder(rank: str) -> str:
    return f"['info', 'low', 'medium', 'high', 'critical'][least(4, {rank}) + 1]"


@query(
    "f06_fuse_severity",
    f"""SELECT alert_id, {_ladder(f"{_RANK} + CAST(asset_criticality = 'critical' AS INTEGER) + CAST(correlation_id IS NOT NULL AS INTEGER)")} AS severity
    FROM stored""",
)
def severity_query(spark, d):
    return fusion.fuse_severity(stored(spark, d)).select("alert_id", "severity")


@query("f07_fuse")
def fuse_query(spark, d):
    return fusion.fuse(alerts_events(spark, d), assets(spark, d)).select(
        "alert_id", F.coalesce("correlation_id", F.lit("")).alias("correlation_id"), "asset_criticality", "severity", "confidence"
    )


ORACLES["f07_fuse"] = _recursive(
    f"""SELECT alert_id, coalesce({_CID}, '') AS correlation_id, {_CRIT_EXPR} AS asset_criticality,
      {_ladder(f"{_RANK} + CAST(s1.c IS NOT NULL OR s2.c IS NOT NULL AS INTEGER) + CAST(anchor IS NOT NULL AS INTEGER)")} AS severity,
      confidence FROM correlated a
    LEFT JOIN (SELECT ip, max(criticality) FILTER (criticality = 'critical') AS c, max(criticality) FILTER (criticality = 'standard') AS s FROM assets GROUP BY ip) s1 ON a.source = s1.ip
    LEFT JOIN (SELECT ip, max(criticality) FILTER (criticality = 'critical') AS c, max(criticality) FILTER (criticality = 'standard') AS s FROM assets GROUP BY ip) s2 ON a.destination = s2.ip"""
)

# ---- analytics ---------------------------------------------------------------------


@query(
    "p21_filter_alerts",
    """SELECT alert_id, timestamp FROM stored WHERE pcap_id IS NULL AND timestamp >= '2024-01-05' AND timestamp <= '2024-01-25'
      AND threat_class = 'beaconing' AND asset_criticality = 'standard'
      AND (source ILIKE '%0.0.1%' OR destination ILIKE '%0.0.1%' OR alert_id ILIKE '%0.0.1%' OR correlation_id ILIKE '%0.0.1%'
        OR supporting_evidence ILIKE '%0.0.1%')""",
)
def filter_query(spark, d):
    return an.filter_alerts(
        stored(spark, d),
        threat_class="beaconing",
        asset_criticality="STANDARD",
        start_time="2024-01-05",
        end_time="2024-01-25",
        search=" 0.0.1 ",
        canonical_only=True,
    ).select("alert_id", "timestamp")


@query(
    "t05_recent_alerts",
    "SELECT alert_id, timestamp FROM stored ORDER BY timestamp DESC, alert_id LIMIT 50",
)
def recent_query(spark, d):
    return an.recent_alerts(stored(spark, d)).select("alert_id", "timestamp")


@query(
    "t02_page",
    "SELECT alert_id, timestamp FROM stored ORDER BY timestamp DESC, alert_id LIMIT 25 OFFSET 75",
)
def page_query(spark, d):
    return an.page(stored(spark, d), [F.desc("timestamp"), F.asc("alert_id")], 3, 25).select("alert_id", "timestamp")


@query(
    "a30_kpi_summary",
    """SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
      count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
      count(DISTINCT correlation_id) AS correlated_incidents, count(DISTINCT source) AS unique_sources,
      count(DISTINCT threat_class) AS unique_threat_classes FROM stored""",
)
def kpi_query(spark, d):
    return an.kpi_summary(stored(spark, d))


@query("a31_threat_distribution", "SELECT threat_class, count(*) AS alerts FROM stored GROUP BY 1")
def threat_distribution_query(spark, d):
    return an.threat_distribution(stored(spark, d))


@query("a31_severity_distribution", "SELECT severity, count(*) AS alerts FROM stored GROUP BY 1")
def severity_distribution_query(spark, d):
    return an.severity_distribution(stored(spark, d))


@query(
    "a32_detector_counts",
    "SELECT threat_class, min(detector) AS detector, count(*) AS alerts, count(DISTINCT correlation_id) AS incidents FROM stored GROUP BY 1",
)
def detector_counts_query(spark, d):
    return an.detector_counts(stored(spark, d))


@query(
    "a33_correlated_split",
    "SELECT count(*) FILTER (correlation_id IS NOT NULL) AS correlated, count(*) FILTER (correlation_id IS NULL) AS uncorrelated FROM stored",
)
def split_query(spark, d):
    return an.correlated_split(stored(spark, d))


@query("a34_alert_timeline", "SELECT substr(timestamp, 1, 16) AS time_bucket, threat_class, count(*) AS alerts FROM stored GROUP BY ALL")
def timeline_query(spark, d):
    return an.alert_timeline(stored(spark, d))


_BIN = {
    "binned": f"SELECT *, {sec('ts')} // 3600 * 3600 + (minute(ts) // 5) * 300 AS b FROM stored",
    "lim": "SELECT min(b) AS lo, max(b) AS hi FROM binned",
}


@query(
    "a35_binned_timeline",
    f"""SELECT g.b AS bin_start, coalesce(alerts, 0) AS alerts, coalesce(threats, 'No alerts') AS threats,
      coalesce(severities, 'NONE') AS severities, coalesce(alerts, 0) >= 2 AS is_peak
    FROM (SELECT unnest(range(lo, hi + 301, 300)) AS b FROM lim) g LEFT JOIN (
      SELECT b, count(*) AS alerts, string_agg(DISTINCT {_LABEL}, ', ' ORDER BY {_LABEL}) AS threats,
        string_agg(DISTINCT upper(severity), ', ' ORDER BY upper(severity)) AS severities FROM binned GROUP BY b) c ON g.b = c.b""",
    _BIN,
)
def binned_query(spark, d):
    return an.binned_timeline(stored(spark, d)).withColumn("bin_start", F.unix_seconds("bin_start"))


@query(
    "a36_multi_threat_timeline",
    f"""SELECT g.b AS bin_start, {_LABEL.replace('threat_class', 'k.threat_class')} AS threat, coalesce(n, 0) AS alerts
    FROM (SELECT unnest(range(lo, hi + 1, 300)) AS b FROM lim) g CROSS JOIN (SELECT DISTINCT threat_class FROM binned) k
    LEFT JOIN (SELECT b, threat_class, count(*) AS n FROM binned GROUP BY ALL) c ON g.b = c.b AND c.threat_class = k.threat_class""",
    _BIN,
)
def multi_query(spark, d):
    return an.multi_threat_timeline(stored(spark, d)).withColumn("bin_start", F.unix_seconds("bin_start"))


_INC = {
    "incidents": """SELECT correlation_id, min(source) AS source, count(*) AS alert_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
      ['info', 'low', 'medium', 'high', 'critical'][max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END)] AS highest_severity,
      string_agg(DISTINCT threat_class, ' -> ' ORDER BY threat_class) AS attack_chain FROM stored WHERE correlation_id IS NOT NULL GROUP BY correlation_id""",
}


@query("a37_incident_groups", "SELECT * FROM incidents", _INC)
def incidents_query(spark, d):
    return an.incident_groups(stored(spark, d)).drop("threat_classes")


@query(
    "p31_filter_incidents",
    """SELECT i.* FROM incidents i WHERE highest_severity IN ('critical', 'high') AND source ILIKE '%.1%'
      AND (correlation_id ILIKE '%TLS%' OR source ILIKE '%TLS%' OR attack_chain ILIKE '%TLS%' OR EXISTS (
        SELECT 1 FROM stored s WHERE s.correlation_id = i.correlation_id AND (destination ILIKE '%TLS%' OR detector ILIKE '%TLS%'
          OR supporting_evidence ILIKE '%TLS%' OR threat_class ILIKE '%TLS%')))""",
    _INC,
)
def filter_incidents_query(spark, d):
    s = stored(spark, d)
    return an.filter_incidents(
        an.incident_groups(s), s, severities=["CRITICAL", "high"], source=".1", search="TLS"
    ).drop("threat_classes")


@query(
    "p33_incident_members",
    "SELECT correlation_id, alert_id, timestamp FROM stored WHERE correlation_id IS NOT NULL",
)
def members_query(spark, d):
    return an.incident_members(stored(spark, d)).select("correlation_id", "alert_id", "timestamp")


@query(
    "p32_tls_matches",
    """SELECT alert_id, json_extract_string(supporting_evidence, '$.ja3') AS ja3, 'No match' AS ja3_match, source, destination,
      substr(timestamp, 1, 19) AS seen, detector FROM stored WHERE threat_class = 'tls_anomaly'""",
)
def tls_matches_query(spark, d):
    return an.tls_matches(stored(spark, d))


@query(
    "a38_asset_summary",
    """SELECT a.ip, name, criticality, zone, coalesce(alerts, 0) AS alerts, last_seen FROM assets a LEFT JOIN (
      SELECT ip, count(*) AS alerts, max(timestamp) AS last_seen FROM (
        SELECT source AS ip, timestamp FROM stored UNION ALL SELECT destination, timestamp FROM stored) GROUP BY ip) t ON a.ip = t.ip""",
)
def asset_query(spark, d):
    return an.asset_summary(stored(spark, d), assets(spark, d))


@query("a40_label_distribution", f"SELECT {_LABEL} AS label, count(*) AS alerts FROM stored GROUP BY 1")
def label_query(spark, d):
    return an.label_distribution(stored(spark, d))


@query(
    "a44_run_breakdown",
    "SELECT pcap_id, threat_class AS item, count(*) AS alerts FROM stored GROUP BY ALL UNION ALL SELECT pcap_id, severity, count(*) FROM stored GROUP BY ALL",
)
def breakdown_query(spark, d):
    s = stored(spark, d)
    return an.run_breakdown(s, "threat_class").unionByName(an.run_breakdown(s, "severity"))


@query(
    "a45_detector_share",
    f"""SELECT threat_class, {_LABEL} AS label, detector, alerts, incidents, round(alerts / sum(alerts) OVER () * 100, 1) AS share_percent
    FROM (SELECT threat_class, min(detector) AS detector, count(*) AS alerts, count(DISTINCT correlation_id) AS incidents FROM stored GROUP BY 1)""",
)
def share_query(spark, d):
    return an.detector_share(stored(spark, d))
