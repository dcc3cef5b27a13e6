"""Queries over stored alerts: filters, counters, timelines, incidents, assets.

``alerts`` columns: the contract of :mod:`wiretally.operators.alerts` plus ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.formats import (
    SEVERITY_LADDER,
    THREAT_ALIASES,
    severity_from_rank,
    severity_rank,
    threat_label,
)


def _has_incident() -> Column:
    return F.coalesce(F.col("correlation_id"), F.lit("")) != ""


def in_scope(alerts: DataFrame, pcap_id: str | None = None, canonical_only: bool = False) -> DataFrame:
    """One capture's alerts, or only those of no capture, or all."""
    if pcap_id:
        return alerts.filter(F.col("pcap_id") == pcap_id)
    if canonical_only:
        return alerts.filter(F.coalesce(F.col("pcap_id"), F.lit("")) == "")
    return alerts


def filter_alerts(
    alerts: DataFrame,
    *,
    threat_class: str | None = None,
    severity: str | None = None,
    source: str | None = None,
    destination: str | None = None,
    asset_criticality: str | None = None,
    detector: str | None = None,
    correlation_id: str | None = None,
    start_time: str | None = None,
    end_time: str | None = None,
    search: str | None = None,
    pcap_id: str | None = None,
    canonical_only: bool = False,
) -> DataFrame:
    """Apply whichever predicates are given; text search ignores case."""
    out = in_scope(alerts, pcap_id, canonical_only)
    equal = {
        "threat_class": threat_class,
        "severity": severity.lower() if severity else None,
        "source": source,
        "destination": destination,
        "asset_criticality": asset_criticality.lower() if asset_criticality else None,
        "detector": detector,
        "correlation_id": correlation_id,
    }
    for column, value in equal.items():
        if value:
            out = out.filter(F.col(column) == value)
    if start_time:
        out = out.filter(F.col("timestamp") >= start_time)
    if end_time:
        out = out.filter(F.col("timestamp") <= end_time)
    if search and search.strip():
        needle = f"%{search.strip()}%"
        fields = ("source", "destination", "alert_id", "correlation_id", "supporting_evidence")
        hit = F.lit(False)
        for column in fields:
            hit = hit | F.coalesce(F.col(column).ilike(needle), F.lit(False))
        out = out.filter(hit)
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered result; ``order`` must end in a unique column."""
    ordered = df.orderBy(*order)
    return ordered.offset(number * size).limit(size) if number else ordered.limit(size)


def recent_alerts(alerts: DataFrame, k: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("timestamp"), "alert_id").limit(k)


def kpi_summary(alerts: DataFrame) -> DataFrame:
    """One row of counters, from a single aggregation."""
    by_severity = [
        F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")
    ]
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *by_severity,
        F.count_distinct(F.when(_has_incident(), F.col("correlation_id"))).alias("correlated_incidents"),
        F.count_distinct("source").alias("unique_sources"),
        F.count_distinct("threat_class").alias("unique_threat_classes"),
    )


def threat_distribution(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("threat_class")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.desc("alerts"), "threat_class")
    )


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """Counts per severity, most severe first; severities not present are left out."""
    name = F.lower("severity")
    return (
        alerts.filter(name.isin(*SEVERITY_LADDER))
        .groupBy(name.alias("severity"))
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.desc(severity_rank(F.col("severity"))))
    )


def detector_counts(alerts: DataFrame) -> DataFrame:
    """Alerts and distinct incidents per class, with the name of one detector."""
    return alerts.groupBy("threat_class").agg(
        F.min("detector").alias("detector"),
        F.count(F.lit(1)).alias("alerts"),
        F.count_distinct(F.when(_has_incident(), F.col("correlation_id"))).alias("incidents"),
    )


def detector_share(alerts: DataFrame) -> DataFrame:
    """Detector counts with the share of all alerts, largest first."""
    counts = detector_counts(alerts)
    total = counts.agg(F.sum("alerts").alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .withColumn("share_percent", F.round(F.col("alerts") / F.col("_total") * 100, 1))
        .withColumn("label", threat_label(F.col("threat_class")))
        .drop("_total")
        .orderBy(F.desc("alerts"), "threat_class")
    )


def correlated_split(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count_if(_has_incident()).alias("correlated"),
        F.count_if(~_has_incident()).alias("uncorrelated"),
    )


def alert_timeline(alerts: DataFrame) -> DataFrame:
    """Alerts per minute and class."""
    return alerts.groupBy(F.substring("timestamp", 1, 16).alias("time_bucket"), "threat_class").agg(
        F.count(F.lit(1)).alias("alerts")
    )


def label_distribution(alerts: DataFrame) -> DataFrame:
    """Alerts per display label, so aliases of a class add up."""
    return (
        alerts.groupBy(threat_label(F.col("threat_class")).alias("label"))
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.desc("alerts"), "label")
    )


def _bin_start(bin_minutes: int) -> Column:
    """Start of the bin inside the hour."""
    hour = F.date_trunc("hour", "ts")
    step = F.floor(F.minute("ts") / bin_minutes) * bin_minutes
    return F.timestamp_seconds(F.unix_seconds(hour) + step * 60)


def _dense_bins(binned: DataFrame, bin_minutes: int, extra: int) -> DataFrame:
    """Every bin between the first and last, made day by day so no array grows with the
    covered range beyond the bins of one day."""
    seconds = bin_minutes * 60
    limits = binned.agg(
        F.unix_seconds(F.min("bin_start")).alias("_lo"),
        (F.unix_seconds(F.max("bin_start")) + extra * seconds).alias("_hi"),
    ).filter(F.col("_lo").isNotNull())
    day = 86_400 // seconds * seconds
    starts = limits.select("_hi", F.explode(F.sequence("_lo", "_hi", F.lit(day))).alias("_day"))
    last = F.least(F.col("_hi"), F.col("_day") + (day - seconds))
    return starts.select(F.explode(F.sequence(F.col("_day"), last, F.lit(seconds))).alias("_bin")).select(
        F.timestamp_seconds("_bin").alias("bin_start")
    )


def binned_timeline(alerts: DataFrame, bin_minutes: int = 5) -> DataFrame:
    """Dense timeline with zero-filled gaps, labels per bin and a peak flag."""
    binned = alerts.withColumn("bin_start", _bin_start(bin_minutes))
    counts = binned.groupBy("bin_start").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.array_join(F.array_sort(F.collect_set(threat_label(F.col("threat_class")))), ", ").alias("threats"),
        F.array_join(F.array_sort(F.collect_set(F.upper("severity"))), ", ").alias("severities"),
    )
    return (
        _dense_bins(binned, bin_minutes, extra=1)
        .join(counts, "bin_start", "left")
        .select(
            "bin_start",
            F.coalesce("alerts", F.lit(0)).alias("alerts"),
            F.coalesce("threats", F.lit("No alerts")).alias("threats"),
            F.coalesce("severities", F.lit("NONE")).alias("severities"),
            (F.coalesce("alerts", F.lit(0)) >= 2).alias("is_peak"),
        )
    )


def multi_threat_timeline(alerts: DataFrame, bin_minutes: int = 5) -> DataFrame:
    """Dense (bin, class) series, zero where a class is silent.

    The grid pairs time bins with the fixed set of threat classes seen, never with rows.
    """
    aliases = F.create_map(*[F.lit(x) for pair in THREAT_ALIASES.items() for x in pair])
    binned = alerts.withColumn("bin_start", _bin_start(bin_minutes)).withColumn(
        "series", F.coalesce(F.try_element_at(aliases, F.col("threat_class")), F.col("threat_class"))
    )
    counts = binned.groupBy("bin_start", "series").agg(F.count(F.lit(1)).alias("alerts"))
    classes = binned.agg(F.collect_set("series").alias("_classes"))  # at most ten classes
    grid = (
        _dense_bins(binned, bin_minutes, extra=0)
        .crossJoin(F.broadcast(classes))
        .select("bin_start", F.explode("_classes").alias("series"))
    )
    return grid.join(counts, ["bin_start", "series"], "left").select(
        "bin_start",
        threat_label(F.col("series")).alias("threat"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"),
    )


def incident_groups(alerts: DataFrame) -> DataFrame:
    """One row per incident with highest severity and attack chain."""
    rank = severity_rank(F.col("severity"))
    return (
        alerts.filter(_has_incident())
        .groupBy("correlation_id")
        .agg(
            F.min("source").alias("source"),
            F.count(F.lit(1)).alias("alert_count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.array_sort(F.collect_set("threat_class")).alias("threat_classes"),
            severity_from_rank(F.max(rank)).alias("highest_severity"),
        )
        .withColumn("attack_chain", F.array_join("threat_classes", " -> "))
    )


def filter_incidents(
    incidents: DataFrame,
    alerts: DataFrame,
    *,
    severities: Iterable[str] = (),
    source: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Incidents by severity, source text and free text over members and chain.

    Members are searched with one semi join instead of one query per incident.
    """
    out = incidents
    wanted = [s.lower() for s in severities]
    if wanted:
        out = out.filter(F.col("highest_severity").isin(*wanted))
    if source:
        out = out.filter(F.col("source").ilike(f"%{source}%"))
    if search:
        needle = f"%{search}%"
        like = lambda c: F.coalesce(F.col(c).ilike(needle), F.lit(False))
        members = (
            alerts.filter(like("destination") | like("detector") | like("supporting_evidence") | like("threat_class"))
            .select("correlation_id")
            .distinct()
            .withColumn("_member", F.lit(True))
        )
        out = (
            out.join(members, "correlation_id", "left")
            .filter(like("correlation_id") | like("source") | like("attack_chain") | F.coalesce("_member", F.lit(False)))
            .drop("_member")
        )
    return out


def incident_members(alerts: DataFrame, correlation_id: str | None = None) -> DataFrame:
    """Members of one incident, or of all, in time order."""
    chosen = alerts.filter(_has_incident())
    if correlation_id:
        chosen = chosen.filter(F.col("correlation_id") == correlation_id)
    return chosen.orderBy("correlation_id", "timestamp", "alert_id")


def asset_summary(alerts: DataFrame, assets: DataFrame) -> DataFrame:
    """Alerts touching each asset as source or destination, and the latest time."""
    touched = (
        alerts.select(F.col("source").alias("ip"), "timestamp")
        .unionByName(alerts.select(F.col("destination").alias("ip"), "timestamp"))
        .groupBy("ip")
        .agg(F.count(F.lit(1)).alias("alerts"), F.max("timestamp").alias("last_seen"))
    )
    order = F.when(F.col("criticality") == "critical", 0).when(F.col("criticality") == "standard", 1).otherwise(2)
    return (
        assets.join(touched, "ip", "left")
        .withColumn("alerts", F.coalesce("alerts", F.lit(0)))
        .orderBy(order, F.desc("alerts"), "ip")
    )


def tls_matches(alerts: DataFrame) -> DataFrame:
    """TLS alerts with fingerprint and match read from their evidence."""
    read = lambda field, default: F.coalesce(
        F.get_json_object("supporting_evidence", f"$.{field}"), F.lit(default)
    )
    return alerts.filter(F.col("threat_class") == "tls_anomaly").select(
        "alert_id",
        read("ja3", "N/A").alias("ja3"),
        read("ja3_match", "No match").alias("ja3_match"),
        "source",
        "destination",
        F.substring("timestamp", 1, 19).alias("seen"),
        "detector",
    )


def run_breakdown(alerts: DataFrame, by: str) -> DataFrame:
    """Alerts per capture and threat class or severity."""
    return alerts.groupBy("pcap_id", F.col(by).alias("item")).agg(F.count(F.lit(1)).alias("alerts"))
