"""The alert contract: construction with defaults and fail-closed validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.formats import SEVERITY_LADDER

# The alert format.
SCHEMA_VERSION = "1.0.0"
THREAT_CLASSES = (
    "reconnaissance",
    "scanning",
    "ddos",
    "beaconing",
    "dga",
    "dga_dns",
    "dns_tunnel",
    "tls_anomaly",
    "exfiltration",
    "anomalous_behavior",
)
LATENCY_CLASSES = ("event_driven", "periodic")
REQUIRED_FIELDS = (
    "alert_id",
    "timestamp",
    "flow_id",
    "threat_class",
    "severity",
    "confidence",
    "source",
    "destination",
    "supporting_evidence",
    "detector",
    "model_version",
    "schema_version",
)
OPTIONAL_FIELDS = {
    "detector_version": "string",
    "subtype": "string",
    "asset_criticality": "string",
    "correlation_id": "string",
    "latency_class": "string",
    "pcap_id": "string",
}
_UUID4 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
_UTC_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]00:00)$"
_OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?[+-]\d{2}:\d{2}$"


def uuid_of(*parts: Column) -> Column:
    """Version-4 shaped id from a digest: a re-run gives the same alert the same id."""
    digest = F.md5(F.concat_ws("|", *parts))
    variant = F.translate(F.substring(digest, 17, 1), "01234567cdef", "89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def make_alerts(
    findings: DataFrame,
    threat_class: str,
    detector: str,
    evidence: list[str],
    *,
    ts: str = "ts",
    model_version: str = "1.0.0",
    latency_class: str = "periodic",
) -> DataFrame:
    """Turn findings into alerts.

    Findings bring source, destination, severity, confidence, a time column and
    optionally flow_id and subtype; ``evidence`` names the columns kept as evidence.
    """
    have = set(findings.columns)
    flow = (
        F.col("flow_id")
        if "flow_id" in have
        else F.concat_ws("_", F.lit(threat_class), "source", "destination")
    )
    out = findings.select(
        uuid_of(F.lit(detector), flow, F.col(ts).cast("string")).alias("alert_id"),
        iso_utc(F.col(ts)).alias("timestamp"),
        F.col(ts).alias("ts"),
        flow.alias("flow_id"),
        F.lit(threat_class).alias("threat_class"),
        F.col("severity"),
        F.col("confidence").cast("double").alias("confidence"),
        F.col("source"),
        F.col("destination"),
        F.to_json(F.struct(*[F.col(c) for c in evidence])).alias("supporting_evidence"),
        F.lit(detector).alias("detector"),
        F.lit(model_version).alias("model_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(model_version).alias("detector_version"),
        (F.col("subtype") if "subtype" in have else F.lit(None).cast("string")).alias("subtype"),
        F.lit(latency_class).alias("latency_class"),
    )
    return with_optional_fields(out)


def with_optional_fields(alerts: DataFrame) -> DataFrame:
    """Add absent optional fields as NULL and fill the version alias both ways."""
    for name, kind in OPTIONAL_FIELDS.items():
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast(kind))
    return alerts.withColumn(
        "model_version", F.coalesce("model_version", "detector_version")
    ).withColumn("detector_version", F.coalesce("detector_version", "model_version"))


def validation_errors() -> Column:
    """Array of rule names an alert breaks; empty when it is valid."""
    confidence = F.col("confidence")
    stamp = F.col("timestamp")
    evidence = F.trim("supporting_evidence")
    missing = [
        F.when(F.col(name).isNull(), F.lit(f"missing:{name}")) for name in REQUIRED_FIELDS
    ]
    rules = [
        F.when(~F.col("alert_id").rlike(_UUID4), "alert_id:not_uuid4"),
        F.when(
            ~stamp.rlike(_UTC_TIME),
            F.when(stamp.rlike(_OFFSET_TIME), "timestamp:not_utc").otherwise("timestamp:invalid"),
        ),
        F.when(
            stamp.rlike(_UTC_TIME) & F.try_to_timestamp(F.substring(stamp, 1, 10)).isNull(),
            "timestamp:invalid",
        ),
        F.when(
            F.isnan(confidence) | (confidence < 0) | (confidence > 1), "confidence:out_of_range"
        ),
        F.when(~F.col("threat_class").isin(*THREAT_CLASSES), "threat_class:unknown"),
        F.when(~F.col("severity").isin(*SEVERITY_LADDER), "severity:unknown"),
        F.when(
            F.col("latency_class").isNotNull() & ~F.col("latency_class").isin(*LATENCY_CLASSES),
            "latency_class:unknown",
        ),
        F.when(
            evidence.rlike(r"^\{\s*\}$") | ~evidence.rlike(r"^\{[\s\S]*\}$"), "evidence:empty"
        ),
    ]
    return F.array_compact(F.array(*missing, *rules))


def validate_alerts(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected with an ``errors`` column)."""
    checked = with_optional_fields(alerts).withColumn("errors", validation_errors())
    return (
        checked.filter(F.size("errors") == 0).drop("errors"),
        checked.filter(F.size("errors") > 0),
    )
