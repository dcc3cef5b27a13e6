"""TLS session features, behaviour score, blacklist lookup and the two-signal verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.config import TlsConfig

_EPSILON = 1e-6
_HASH = r"^[0-9a-f]{32}$"


def first_per_uid(df: DataFrame) -> DataFrame:
    """Earliest record of each uid; ties fall to the smallest row digest.

    ``min_by`` aggregates on the map side, so a uid with a flood of records is reduced
    before the shuffle instead of being sorted in one task.
    """
    columns = [c for c in df.columns if c != "uid"]
    packed = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    order = F.struct(F.col("ts"), F.xxhash64(packed))
    return (
        df.filter(F.col("uid").isNotNull() & (F.trim("uid") != ""))
        .withColumn("uid", F.trim("uid"))
        .groupBy("uid")
        .agg(F.min_by(packed, order).alias("_row"))
        .select("uid", "_row.*")
    )


def join_ssl_conn(ssl: DataFrame, conn: DataFrame) -> DataFrame:
    """One-to-one join of handshakes and connections by uid; unmatched rows drop out."""
    left = first_per_uid(ssl)
    right = first_per_uid(conn)
    shared = [c for c in right.columns if c in left.columns and c != "uid"]
    return left.join(right.drop(*shared), "uid")


def tls_features(joined: DataFrame) -> DataFrame:
    """Mean packet size, byte ratio, packet count and duration of a session."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total_bytes = zero("orig_bytes") + zero("resp_bytes")
    packets = zero("orig_pkts") + zero("resp_pkts")
    replies = F.when(zero("resp_bytes") > 0, zero("resp_bytes").cast("double")).otherwise(_EPSILON)
    return (
        joined.withColumn(
            "mean_packet_size", F.bround(total_bytes / F.greatest(packets, F.lit(1)), 4)
        )
        .withColumn("byte_ratio", F.bround(zero("orig_bytes") / replies, 4))
        .withColumn("packet_count", packets)
        .withColumn(
            "duration",
            F.bround(F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)), 4),
        )
    )


def behavior_score(cfg: TlsConfig = TlsConfig()) -> Column:
    """Upload-heavy sessions with large packets approach 1, browsing stays near 0."""
    above = lambda c, ref, scale: F.greatest((F.col(c) - ref) / scale, F.lit(0.0))
    raw = cfg.ratio_weight * above(
        "byte_ratio", cfg.ratio_reference, cfg.ratio_scale
    ) + cfg.size_weight * above("mean_packet_size", cfg.size_reference, cfg.size_scale)
    return F.bround(raw / (1 + raw), 4)


def match_ja3(sessions: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Look both fingerprints up in the blacklist (columns hash, family, threat).

    Plain equi joins: the optimizer broadcasts the list while its measured size is below
    the session's limit and shuffles beyond it.
    """
    listed = blacklist.groupBy("hash").agg(
        F.min("family").alias("family"), F.min("threat").alias("threat")
    )
    out = sessions
    for column in ("ja3", "ja3s"):
        clean = F.lower(F.trim(F.col(column)))
        entries = listed.select(
            F.col("hash").alias(f"_{column}"),
            F.col("family").alias(f"{column}_family"),
            F.col("threat").alias(f"{column}_threat"),
        )
        out = (
            out.withColumn(f"_{column}", F.when(clean.rlike(_HASH), clean))
            .join(entries, f"_{column}", "left")
            .drop(f"_{column}")
        )
    return out.withColumn(
        "fingerprint_match", F.col("ja3_family").isNotNull() | F.col("ja3s_family").isNotNull()
    )


def fusion_state() -> Column:
    """Which of the two signals fired."""
    known, odd = F.col("fingerprint_match"), F.col("behavior_anomalous")
    return (
        F.when(known & odd, "both")
        .when(known, "fingerprint_only")
        .when(odd, "behavior_only")
        .otherwise("none")
    )


def score_tls(features: DataFrame, blacklist: DataFrame, cfg: TlsConfig = TlsConfig()) -> DataFrame:
    """Every session with both signals, the state and, where one fired, the verdict."""
    state = F.col("fusion_state")
    return (
        match_ja3(features, blacklist)
        .withColumn("behavior_score", behavior_score(cfg))
        .withColumn("behavior_anomalous", F.col("behavior_score") >= cfg.threshold)
        .withColumn("fusion_state", fusion_state())
        .withColumn(
            "confidence",
            F.when(state == "both", 0.90).when(state == "fingerprint_only", 0.75).when(state == "behavior_only", 0.65),
        )
        .withColumn("severity", F.when(state == "both", "high").when(state != "none", "medium"))
        .withColumn(
            "subtype",
            F.when(state == "both", "encrypted_malware")
            .when(state == "fingerprint_only", "suspicious_fingerprint")
            .when(state == "behavior_only", "tls_behavioral_anomaly"),
        )
    )


def detect_tls(features: DataFrame, blacklist: DataFrame, cfg: TlsConfig = TlsConfig()) -> DataFrame:
    return score_tls(features, blacklist, cfg).filter(F.col("fusion_state") != "none")


def state_counts(scored: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Sessions per dataset and fusion state, with the mean behaviour score."""
    return scored.groupBy(dataset, "fusion_state").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg("behavior_score").alias("mean_behavior_score"),
    )
