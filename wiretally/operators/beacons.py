"""Beacon scoring of connection keys.

Input are the mergeable distributions of :mod:`wiretally.operators.hourly`:
(key, second, n) and (key, bytes, n). They stay relations: quartiles and deviations are read
off running weights, so no array grows with a key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.config import STROBE_CONNECTIONS, BeaconConfig
from wiretally.functions import beaconmath as bm
from wiretally.functions.stats import order_statistics


def eligible_keys(totals: DataFrame, cfg: BeaconConfig = BeaconConfig(), strobe: int = STROBE_CONNECTIONS) -> DataFrame:
    """Keys with enough distinct seconds and fewer connections than a strobe."""
    return totals.filter((F.col("ts_unique") >= cfg.min_unique_ts) & (F.col("count") < strobe)).select("hash")


def distinct_counts(values: Column) -> Column:
    """Distinct values of a sorted array with their counts, in order."""
    return F.transform(
        F.array_distinct(values),
        lambda v: F.struct(v.alias("value"), F.size(F.filter(values, lambda x: x == v)).alias("n")),
    )


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Relational form of :func:`distinct_counts`: one row per key and distinct value."""
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def mode_of(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key; the smallest wins a tie."""
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("n"), -F.col(value))).alias("mode"), F.max("n").alias("mode_count")
    )


def key_seconds(seconds: DataFrame) -> DataFrame:
    """Hours merged: one row per key and second, dealt by key for all that follows."""
    merged = seconds.groupBy("hash", F.unix_seconds("ts").alias("ts_sec")).agg(F.sum("n").alias("n"))
    return merged.repartition("hash")


def gap_counts(per_second: DataFrame) -> DataFrame:
    """(hash, gap, n) of the steps between the distinct seconds of each key."""
    before = F.lag("ts_sec").over(Window.partitionBy("hash").orderBy("ts_sec"))
    gaps = per_second.select("hash", (F.col("ts_sec") - before).alias("gap")).where(F.col("gap").isNotNull())
    return gaps.groupBy("hash", "gap").agg(F.count(F.lit(1)).alias("n"))


def interval_counts(seconds: DataFrame) -> DataFrame:
    """Gap lengths per key with their frequency, repeats within a second as gap 0."""
    per_second = key_seconds(seconds)
    repeats = per_second.groupBy("hash").agg((F.sum("n") - F.count(F.lit(1))).alias("n"))
    zeros = repeats.where(F.col("n") > 0).select("hash", F.lit(0).cast("bigint").alias("gap"), "n")
    return gap_counts(per_second).unionByName(zeros)


def beacon_features(
    seconds: DataFrame, sizes: DataFrame, keys: DataFrame, span: DataFrame, cfg: BeaconConfig = BeaconConfig()
) -> DataFrame:
    """Per eligible key: order statistics of its gaps and sizes, and the 24-bar histogram.

    ``span`` is one row (min_ts, max_ts). Gaps and sizes stay (key, value, count) rows and are
    read off running weights; the bars are conditional sums. Only the bars, whose number is
    fixed, form an array. A key left by the strobe rule has fewer than 86,400 rows.
    """
    limits = span.select(
        F.unix_seconds("min_ts").alias("lo"), F.unix_seconds("max_ts").alias("hi")
    )
    per_second = key_seconds(seconds.join(keys, "hash", "left_semi"))
    barred = per_second.crossJoin(F.broadcast(limits)).withColumn(  # one row
        "bar", bm.bin_index(F.col("ts_sec"), F.col("lo"), F.col("hi"), cfg.bins)
    )
    bars = [F.coalesce(F.sum(F.when(F.col("bar") == i, F.col("n"))), F.lit(0)) for i in range(cfg.bins)]
    timing = barred.groupBy("hash").agg(
        F.min("ts_sec").alias("first_ts"),
        F.max("ts_sec").alias("last_ts"),
        F.array(*bars).alias("hist"),
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
    )

    def named(stats: DataFrame, prefix: str) -> DataFrame:
        return stats.select("hash", *[F.col(c).alias(f"{prefix}_{c}") for c in ("count", "q1", "q2", "q3", "mad")])

    amounts = sizes.join(keys, "hash", "left_semi").groupBy("hash", "src_ip_bytes").agg(F.sum("n").alias("n"))
    by_gap = named(order_statistics(gap_counts(per_second), "hash", "gap", "n"), "gap")
    by_size = named(order_statistics(amounts, "hash", "src_ip_bytes", "n"), "size")
    return timing.join(by_gap, "hash").join(by_size, "hash")


def score_beacons(features: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    """All partial scores and the weighted beacon score of each key.

    Keys with fewer than three gaps, three sizes or an empty range have no row and
    stay available to the other indicators.
    """
    c = F.col
    bars = features.filter((c("gap_count") >= 3) & (c("size_count") >= 3) & (c("hi") > c("lo")))
    stage = (
        bars.withColumn("ts_skew", bm.bowley_skew(c("gap_q1"), c("gap_q2"), c("gap_q3")))
        .withColumn("ds_skew", bm.bowley_skew(c("size_q1"), c("size_q2"), c("size_q3")))
        .withColumn("ts_mad", c("gap_mad"))
        .withColumn("ds_mad", c("size_mad"))
        .withColumn(
            "ts_score", bm.statistical_score(c("ts_skew"), bm.mad_score(c("gap_q2"), c("ts_mad"), 1.0))
        )
        .withColumn(
            "ds_score", bm.statistical_score(c("ds_skew"), bm.mad_score(c("size_q2"), c("ds_mad"), 0.0))
        )
        .withColumn("total_bars", bm.total_bars(c("hist")))
        .withColumn("longest_run", bm.longest_run(c("hist"), cfg.bins))
        .withColumn("cv_score", bm.cv_score(c("hist")))
        .withColumn(
            "_freq", bm.frequency_counts(bm.frequency_groups(c("hist"), cfg.mode_sensitivity))
        )
        .withColumn("bimodal_score", bm.bimodal_score(c("_freq"), c("total_bars"), cfg))
        .withColumn("hist_score", F.greatest("cv_score", "bimodal_score"))
        .withColumn(
            "dur_score",
            bm.duration_score(c("first_ts"), c("last_ts"), c("lo"), c("hi"), c("total_bars"), c("longest_run"), cfg),
        )
    )
    # Parts have three decimals; exact decimals keep a tie such as 0.7485 a tie.
    exact = lambda part, weight: c(part).cast("decimal(6,3)") * F.lit(Decimal(str(weight)))
    weighted = (
        exact("ts_score", cfg.ts_weight)
        + exact("ds_score", cfg.ds_weight)
        + exact("dur_score", cfg.duration_weight)
        + exact("hist_score", cfg.histogram_weight)
    )
    return stage.withColumn("beacon_score", F.round(weighted, 3).cast("double")).drop("_freq")


def score_keys(
    totals: DataFrame,
    seconds: DataFrame,
    sizes: DataFrame,
    span: DataFrame,
    cfg: BeaconConfig = BeaconConfig(),
    scored_only: bool = False,
) -> DataFrame:
    """Roll-up rows with their beacon score (NULL where not eligible, unless ``scored_only``)."""
    scores = score_beacons(beacon_features(seconds, sizes, eligible_keys(totals, cfg), span, cfg), cfg)
    kept = ["hash", "beacon_score", "ts_score", "ds_score", "hist_score", "dur_score"]
    return totals.join(scores.select(*kept), "hash", "inner" if scored_only else "left")
