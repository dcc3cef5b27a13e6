"""Findings of the pair analysis as alerts: normalisation, thresholds, deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.formats import severity_rank


def normalize_severity(native: Column, score: Column | None = None) -> Column:
    """Native severity, or one derived from the score where the native one says nothing."""
    native = F.lower(F.trim(native))
    quiet = F.lit("info")
    if score is not None:
        quiet = F.when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("info")
    return (
        F.when(native.isin("critical", "high", "medium", "low"), native)
        .when(native.isin("none", "info"), quiet)
        .otherwise("medium")
    )


def normalize_findings(rows: DataFrame) -> DataFrame:
    """Typed findings from the 18 report columns; rows without endpoints or a numeric
    beacon score drop out. The first port entry gives port, protocol and service."""
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    number = lambda c, kind: F.coalesce(text(c).try_cast(kind), F.lit(0).cast(kind))
    parts = F.split(F.trim(F.get(F.split(text("Port:Proto:Service"), ","), F.lit(0))), ":")
    part = lambda i, default: F.coalesce(F.trim(F.get(parts, F.lit(i))), F.lit(default))
    typed = rows.select(
        text("Source IP").alias("source"),
        text("Destination IP").alias("destination"),
        text("FQDN").alias("fqdn"),
        text("Beacon Score").try_cast("double").alias("beacon_score"),
        F.lower(text("Strobe")).isin("true", "1", "t", "yes").alias("is_strobe"),
        number("Connection Count", "bigint").alias("connection_count"),
        number("Total Bytes", "bigint").alias("total_bytes"),
        number("Total Duration", "double").alias("total_duration"),
        text("Port:Proto:Service").alias("port_proto_service"),
        part(0, "").try_cast("int").alias("destination_port"),
        part(1, "tcp").alias("protocol"),
        part(2, "").alias("service"),
        text("Subdomains").try_cast("bigint").alias("subdomains"),
        text("C2 Over DNS Score").try_cast("double").alias("c2_score"),
        text("First Seen").alias("first_seen"),
        text("Prevalence").alias("prevalence"),
        text("Modifiers").alias("modifiers"),
        text("Severity").alias("native_severity"),
    )
    return typed.withColumn("severity", normalize_severity(F.col("native_severity"), F.col("beacon_score")))


def beacon_findings(typed: DataFrame) -> DataFrame:
    """Findings with both endpoints and a score, with their stable fingerprint."""
    port = F.coalesce(F.col("destination_port").cast("string"), F.lit("any"))
    service = F.when(F.col("service") == "", "unknown").otherwise(F.col("service"))
    return typed.filter(
        (F.col("source") != "") & (F.col("destination") != "") & F.col("beacon_score").isNotNull()
    ).withColumn(
        "fingerprint", F.concat_ws("_", F.lit("beacon"), "source", "destination", port, service)
    )


def beacon_candidates(found: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Not a strobe, a positive score, and at or above the alert threshold."""
    score = F.col("beacon_score")
    return found.filter(~F.col("is_strobe") & (score > 0) & (score >= threshold))


def tunnel_findings(typed: DataFrame) -> DataFrame:
    """Findings with a positive DNS command-and-control score."""
    named = lambda c: F.when(F.col(c) == "", "unknown").otherwise(F.col(c))
    return (
        typed.filter(F.col("c2_score") > 0)
        .withColumn("source", named("source"))
        .withColumn("destination", named("destination"))
        .withColumn("severity", normalize_severity(F.col("native_severity")))
        .withColumn(
            "fingerprint",
            F.concat_ws("_", F.lit("c2_over_dns"), "source", "destination", F.lower("fqdn")),
        )
    )


def as_beacon_alert_rows(found: DataFrame) -> DataFrame:
    """Columns the alert builder needs, confidence being the clipped score."""
    clipped = F.least(F.greatest(F.bround("beacon_score", 4), F.lit(0.0)), F.lit(1.0))
    return (
        found.withColumn("confidence", clipped)
        .withColumn("flow_id", F.col("fingerprint"))
        .withColumn("subtype", F.lit("c2_beaconing"))
    )


def as_tunnel_alert_rows(found: DataFrame) -> DataFrame:
    clipped = F.least(F.greatest(F.bround("c2_score", 4), F.lit(0.0)), F.lit(1.0))
    return (
        found.withColumn("confidence", clipped)
        .withColumn("flow_id", F.col("fingerprint"))
        .withColumn("subtype", F.lit("c2_over_dns"))
    )


# ---- deduplication across cycles ---------------------------------------------------


def dedup_beacons(state: DataFrame, found: DataFrame, delta: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """One cycle: (findings to emit with their status, new state).

    A fingerprint is emitted when new, when its severity ranks higher than the stored
    one, or when its score rose by ``delta``. Suppressed findings leave the stored score
    alone. ``state``: fingerprint, last_score, last_severity, cycles. Findings hold a
    fingerprint once per cycle; the highest score is taken if not.
    """
    current = found.groupBy("fingerprint").agg(
        F.max_by(F.struct(*[F.col(c) for c in found.columns if c != "fingerprint"]), F.struct("beacon_score", "severity")).alias("_f")
    ).select("fingerprint", "_f.*")
    rank = lambda c: severity_rank(F.col(c))
    known = F.col("last_score").isNotNull()
    escalated = rank("severity") > rank("last_severity")
    raised = F.round(F.col("beacon_score") - F.col("last_score"), 9) >= delta
    judged = current.join(state, "fingerprint", "left").withColumn(
        "change_status",
        F.when(~known, "new_finding").when(escalated | raised, "materially_changed"),
    )
    emitted = judged.filter(F.col("change_status").isNotNull()).drop("last_score", "last_severity", "cycles")
    moved = F.col("change_status").isNotNull()
    seen = judged.select(
        "fingerprint",
        F.when(moved, F.col("beacon_score")).otherwise(F.col("last_score")).alias("last_score"),
        F.when(moved, F.col("severity")).otherwise(F.col("last_severity")).alias("last_severity"),
        (F.coalesce("cycles", F.lit(0)) + 1).alias("cycles"),
    )
    unseen = state.join(current.select("fingerprint"), "fingerprint", "left_anti")
    return emitted, seen.unionByName(unseen)


def dedup_tunnels(state: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First sight of each fingerprint only; (findings to emit, new state)."""
    rest = [c for c in found.columns if c != "fingerprint"]
    fresh = (
        found.join(state, "fingerprint", "left_anti")
        .groupBy("fingerprint")
        .agg(F.max_by(F.struct(*rest), F.col("c2_score")).alias("_f"))
        .select("fingerprint", "_f.*")
    )
    return fresh, state.select("fingerprint").unionByName(fresh.select("fingerprint"))


def experiment_summary(found: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per dataset: findings, candidates, those above the threshold and the top pair."""
    candidate = ~F.col("is_strobe") & (F.col("beacon_score") > 0)
    return found.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(candidate).alias("candidates"),
        F.count_if(candidate & (F.col("beacon_score") >= threshold)).alias("above_threshold"),
        F.max("beacon_score").alias("top_score"),
        F.max_by("fingerprint", F.struct("beacon_score", "fingerprint")).alias("top_fingerprint"),
    )
