"""Display and severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.config import HIGH_SCORE, LOW_SCORE, MEDIUM_SCORE, NONE_SCORE

# Unit names of the readable byte size.
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
# Severities from lowest to highest, and their display order.
SEVERITY_LADDER = ("info", "low", "medium", "high", "critical")
# Display names of threat classes, and classes shown under another one.
THREAT_LABELS = {
    "ddos": "DDoS",
    "reconnaissance": "Reconnaissance",
    "dga_dns": "DGA / DNS",
    "dns_tunnel": "DNS Tunnelling",
    "beaconing": "C2 Beaconing",
    "tls_anomaly": "Encrypted Malware / TLS",
    "exfiltration": "Exfiltration",
    "anomalous_behavior": "AI Behavioral Anomaly",
}
THREAT_ALIASES = {"dga": "dga_dns", "scanning": "reconnaissance"}


def severity_band(score: Column) -> Column:
    """Band of a final score; the critical limit is exclusive, the others inclusive."""
    score = F.round(score, 9)  # sums such as 0.6 + 0.2 must not miss their limit
    return (
        F.when(score > HIGH_SCORE, "critical")
        .when(score >= MEDIUM_SCORE, "high")
        .when(score >= LOW_SCORE, "medium")
        .when(score >= NONE_SCORE, "low")
        .otherwise("none")
    )


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; unknown text ranks below info."""
    ranked = F.lit(-1)
    for rank, name in enumerate(SEVERITY_LADDER):
        ranked = F.when(severity == name, rank).otherwise(ranked)
    return ranked


def severity_from_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITY_LADDER]), rank)


def readable_bytes(value: Column) -> Column:
    """Byte size with two decimals in binary units."""
    text = F.format_string("%.2f EiB", value / F.lit(float(1024 ** 6)))
    for power in reversed(range(6)):
        text = F.when(
            value < float(1024 ** (power + 1)),
            F.format_string(f"%.2f {BYTE_UNITS[power]}", value / F.lit(float(1024**power))),
        ).otherwise(text)
    return text


def time_ago(seconds: Column) -> Column:
    """Whole units of elapsed time: years, months, days, hours or minutes ago."""
    steps = [(8760 * 3600, "year"), (720 * 3600, "month"), (24 * 3600, "day"), (3600, "hour")]
    count = F.floor(seconds / 60)
    text = F.concat(count.cast("string"), F.when(count == 1, " minute ago").otherwise(" minutes ago"))
    for size, unit in reversed(steps):
        n = F.floor(seconds / size)
        text = F.when(
            seconds >= size,
            F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago")),
        ).otherwise(text)
    return text


def threat_label(threat_class: Column) -> Column:
    """Display name of a threat class; unknown names are shown as they are."""
    names = dict(THREAT_LABELS)
    names.update({alias: THREAT_LABELS[key] for alias, key in THREAT_ALIASES.items()})
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, threat_class), threat_class)
