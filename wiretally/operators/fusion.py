"""Fusion: validation, correlation, asset criticality and the final severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.formats import severity_from_rank, severity_rank
from wiretally.operators.alerts import validate_alerts
from wiretally.operators.correlate import WINDOW_SECONDS, correlate

# Severity a threat class starts from.
BASE_SEVERITY = {
    "reconnaissance": "low",
    "scanning": "low",
    "beaconing": "medium",
    "dga": "medium",
    "dga_dns": "medium",
    "tls_anomaly": "medium",
    "ddos": "high",
    "dns_tunnel": "high",
    "exfiltration": "high",
    "anomalous_behavior": "medium",
}


def resolve_criticality(alerts: DataFrame, assets: DataFrame) -> DataFrame:
    """Criticality of either endpoint: critical beats standard beats unknown.

    Two left joins on the address; assets are de-duplicated first so no alert multiplies.
    """
    known = assets.groupBy("ip").agg(F.max(F.lower("criticality") == "critical").alias("critical"),
                                     F.max(F.lower("criticality") == "standard").alias("standard"))
    side = lambda name: known.select(
        F.col("ip").alias(name),
        F.col("critical").alias(f"_{name}_critical"),
        F.col("standard").alias(f"_{name}_standard"),
    )
    joined = alerts.join(side("source"), "source", "left").join(side("destination"), "destination", "left")
    either = lambda flag: F.coalesce(F.col(f"_source_{flag}"), F.lit(False)) | F.coalesce(
        F.col(f"_destination_{flag}"), F.lit(False)
    )
    return joined.withColumn(
        "asset_criticality",
        F.when(either("critical"), "critical").when(either("standard"), "standard").otherwise("unknown"),
    ).drop(*[f"_{s}_{f}" for s in ("source", "destination") for f in ("critical", "standard")])


def base_severity(threat_class: Column) -> Column:
    level = F.lit("medium")
    for severity in ("low", "high"):
        names = [c for c, s in BASE_SEVERITY.items() if s == severity]
        level = F.when(F.lower(threat_class).isin(*names), severity).otherwise(level)
    return level


def fused_severity(threat_class: Column, criticality: Column, correlated: Column) -> Column:
    """Base severity, one step up if critical, one step up if correlated, capped."""
    steps = (F.lower(criticality) == "critical").cast("int") + correlated.cast("int")
    return severity_from_rank(F.least(severity_rank(base_severity(threat_class)) + steps, F.lit(4)))


def fuse_severity(alerts: DataFrame) -> DataFrame:
    """Replace severity by the fused one; confidence is left alone."""
    correlated = F.coalesce(F.col("correlation_id"), F.lit("")) != ""
    return alerts.withColumn(
        "severity",
        fused_severity(
            F.col("threat_class"), F.coalesce("asset_criticality", F.lit("unknown")), correlated
        ),
    )


def fuse(alerts: DataFrame, assets: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Validate, correlate, resolve criticality, set severity, validate again."""
    valid, _ = validate_alerts(alerts)
    correlated = correlate(valid.drop("correlation_id"), window_seconds)
    fused = fuse_severity(resolve_criticality(correlated.drop("asset_criticality"), assets))
    final, _ = validate_alerts(fused)
    return final
