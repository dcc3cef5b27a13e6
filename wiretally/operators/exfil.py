"""Data-exfiltration windows, host baselines and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.config import ExfilConfig
from wiretally.functions.net import internal_to_external, with_addresses


def outbound_only(conn: DataFrame, cfg: ExfilConfig = ExfilConfig()) -> DataFrame:
    """Connections from an internal source to a routable external destination."""
    return (
        with_addresses(conn, {"_src": "src", "_dst": "dst"})
        .filter(internal_to_external("_src", "_dst", cfg.internal_subnets, cfg.special_subnets))
        .drop("_src", "_dst")
    )


def exfil_windows(conn: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Outbound and inbound payload per (source, destination, tumbling window)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        conn.groupBy(F.window("ts", f"{window_seconds} seconds").alias("w"), "src", "dst")
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.sum(zero("orig_bytes")).alias("outbound_bytes"),
            F.sum(zero("resp_bytes")).alias("inbound_bytes"),
            F.sum(zero("orig_pkts")).alias("orig_pkts"),
            F.sum(zero("resp_pkts")).alias("resp_pkts"),
            F.sum(F.coalesce("duration", F.lit(0.0))).alias("duration_sum"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*")
        .drop("w")
        .withColumn(
            "byte_ratio", F.col("outbound_bytes") / F.greatest(F.col("inbound_bytes"), F.lit(1))
        )
    )


def host_baseline(windows: DataFrame) -> DataFrame:
    """Rounded ratio and volume statistics of each source over its windows."""
    return windows.groupBy("src").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.bround(F.avg("byte_ratio"), 4).alias("mean_ratio"),
        F.bround(F.stddev_pop("byte_ratio"), 4).alias("std_ratio"),
        F.bround(F.max("byte_ratio"), 4).alias("max_ratio"),
        F.bround(F.avg("outbound_bytes"), 2).alias("mean_volume"),
        F.bround(F.stddev_pop("outbound_bytes"), 2).alias("std_volume"),
        F.max("outbound_bytes").alias("max_volume"),
    )


def with_deviation(
    windows: DataFrame, baseline: DataFrame, cfg: ExfilConfig = ExfilConfig()
) -> DataFrame:
    """Attach the distance of each window from its source's baseline."""
    enough = F.coalesce(F.col("sample_count") >= cfg.min_observations, F.lit(False))
    spread = F.greatest(F.col("std_ratio"), F.lit(0.05))
    return (
        windows.join(baseline.select("src", "sample_count", "mean_ratio", "std_ratio"), "src", "left")
        .withColumn(
            "baseline_deviation",
            F.when(enough, F.bround((F.col("byte_ratio") - F.col("mean_ratio")) / spread, 4)).otherwise(0.0),
        )
        .withColumn(
            "ratio_multiple",
            F.when(
                enough,
                F.bround(F.col("byte_ratio") / F.greatest(F.col("mean_ratio"), F.lit(0.01)), 2),
            ).otherwise(1.0),
        )
        .withColumn("insufficient_baseline", ~enough)
        .withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    )


def exfil_severity() -> Column:
    volume, ratio = F.col("outbound_bytes"), F.col("byte_ratio")
    return (
        F.when((volume >= 10_000_000) | (ratio >= 200), "critical")
        .when((volume >= 1_000_000) | (ratio >= 50), "high")
        .otherwise("medium")
    )


def exfil_confidence(cfg: ExfilConfig = ExfilConfig()) -> Column:
    decades = lambda excess: F.log10(F.greatest(excess, F.lit(1.0)))
    raw = (
        F.lit(0.60)
        + 0.15 * decades(F.col("byte_ratio") / F.lit(max(cfg.ratio, 1.0)))
        + 0.05 * decades(F.col("outbound_bytes") / F.lit(float(max(cfg.volume_floor, 1))))
    )
    return F.bround(F.least(F.greatest(raw, F.lit(0.50)), F.lit(0.95)), 2)


def detect_exfil(
    windows: DataFrame, baseline: DataFrame, cfg: ExfilConfig = ExfilConfig()
) -> DataFrame:
    """Windows sending far more than they receive, above the volume floor."""
    suspicious = windows.filter(
        (F.col("byte_ratio") > cfg.ratio) & (F.col("outbound_bytes") >= cfg.volume_floor)
    )
    start = F.col("window_start").cast("bigint").cast("string")
    end = F.col("window_end").cast("bigint").cast("string")
    return (
        with_deviation(suspicious, baseline, cfg)
        .withColumn("severity", exfil_severity())
        .withColumn("confidence", exfil_confidence(cfg))
        .withColumn("flow_id", F.concat_ws("_", F.lit("exfil"), "src", "dst", start, end))
    )


def experiment_summary(windows: DataFrame, findings: DataFrame) -> DataFrame:
    """Per dataset: bytes each way, ratio, largest window and number of findings."""
    totals = windows.groupBy("dataset").agg(
        F.sum("outbound_bytes").alias("outbound_bytes"),
        F.sum("inbound_bytes").alias("inbound_bytes"),
        F.max("outbound_bytes").alias("max_window_volume"),
    )
    hits = findings.groupBy("dataset").agg(F.count(F.lit(1)).alias("alerts"))
    return (
        totals.withColumn(
            "byte_ratio", F.col("outbound_bytes") / F.greatest(F.col("inbound_bytes"), F.lit(1))
        )
        .join(hits, "dataset", "left")
        .withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    )
