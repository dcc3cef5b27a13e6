"""Beacon statistics as array expressions.

All inputs are sorted arrays whose length is bounded by the strobe rule (a key with
86,400 or more connections is never scored), so an array never outgrows one day of
seconds. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.config import BeaconConfig, Thresholds, LOW_SCORE, MEDIUM_SCORE, HIGH_SCORE, NONE_SCORE


def _half(value: Column) -> Column:
    return F.floor(value / 2).cast("int")


def median_sorted(values: Column) -> Column:
    n = F.size(values)
    return (F.get(values, _half(n - 1)) + F.get(values, _half(n))) / F.lit(2.0)


def quartiles(values: Column) -> tuple[Column, Column, Column]:
    """Quartiles by the median of halves, leaving out the middle of an odd count."""
    n = F.size(values)
    half = _half(n)
    lower = F.slice(values, F.lit(1), half)
    upper = F.slice(values, _half(n + 1) + 1, half)
    return median_sorted(lower), median_sorted(values), median_sorted(upper)


def bowley_skew(q1: Column, q2: Column, q3: Column) -> Column:
    spread = q3 - q1
    return F.when(
        (spread >= 10) & (q2 != q1) & (q2 != q3), (q1 + q3 - 2 * q2) / spread
    ).otherwise(F.lit(0.0))


def mad(values: Column, median: Column) -> Column:
    return median_sorted(F.array_sort(F.transform(values, lambda v: F.abs(v - median))))


def mad_score(median: Column, deviation: Column, default: float) -> Column:
    raw = F.when(median >= 1, (median - deviation) / median).otherwise(F.lit(default))
    return F.greatest(raw, F.lit(0.0))


def statistical_score(skew: Column, mad_part: Column) -> Column:
    return F.round((1 - F.abs(skew) + mad_part) / 2, 3)


def deltas(ts: Column) -> Column:
    """Gaps between consecutive entries of a sorted array."""
    n = F.size(ts)
    return F.zip_with(
        F.slice(ts, F.lit(2), F.greatest(n - 1, F.lit(0))),
        F.slice(ts, F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda later, earlier: later - earlier,
    )


def bin_index(ts: Column, low: Column, high: Column, bins: int) -> Column:
    """Histogram bin of a timestamp: left-closed, the last bin closed on both sides.

    Values below the first edge count in bin 0, values above the last in the last bin.
    """
    step = (high - low) / F.lit(float(bins))
    raw = F.floor(F.try_divide(ts - low, step))  # an empty range has one bin
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def total_bars(hist: Column) -> Column:
    return F.size(F.filter(hist, lambda v: v > 0))


def longest_run(hist: Column, bins: int) -> Column:
    """Longest run of non-empty bars, wrapping round the end, at most ``bins``."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, bar: Column) -> Column:
        run = F.when(bar > 0, state["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    folded = F.aggregate(F.concat(hist, hist), start, step)
    return F.least(folded["best"], F.lit(bins))


def cv_score(hist: Column) -> Column:
    """Flatness of a histogram: one minus the coefficient of variation."""
    n = F.size(hist)
    total = F.aggregate(hist, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(hist, F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    cv = F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0))) / total
    return F.when(cv > 1, F.lit(0.0)).otherwise(F.least(F.round(1 - cv, 3), F.lit(1.0)))


def frequency_groups(hist: Column, sensitivity: float) -> Column:
    """Heights of the non-empty bars, each rounded down to its frequency bin."""
    width = F.ceil(F.array_max(hist) * F.lit(sensitivity)).cast("double")
    return F.transform(
        F.filter(hist, lambda v: v > 0), lambda v: (F.floor(v / width) * width).cast("int")
    )


def frequency_counts(groups: Column) -> Column:
    """Bars per frequency bin, most common first."""
    return F.array_sort(
        F.transform(
            F.array_distinct(groups),
            lambda g: F.size(F.filter(groups, lambda x: x == g)),
        ),
        lambda a, b: b - a,
    )


def bimodal_score(counts: Column, bars: Column, cfg: BeaconConfig) -> Column:
    """Share of bars in the two most common frequency bins."""
    top_two = F.get(counts, F.lit(0)) + F.coalesce(F.get(counts, F.lit(1)), F.lit(0))
    fit = top_two / F.greatest(bars - cfg.bimodal_outliers, F.lit(1)).cast("double")
    return F.when(
        bars >= cfg.bimodal_min_hours, F.least(F.round(fit, 3), F.lit(1.0))
    ).otherwise(F.lit(0.0))


def _ceil3(value: Column) -> Column:
    return F.least(F.ceil(value * 1000) / F.lit(1000.0), F.lit(1.0))


def duration_score(
    first: Column, last: Column, low: Column, high: Column, bars: Column, run: Column, cfg: BeaconConfig
) -> Column:
    """Coverage of the range or consistency of the hours seen, whichever is larger."""
    coverage = _ceil3(F.try_divide(last - first, high - low))
    consistency = _ceil3(run / F.lit(float(cfg.ideal_hours_seen)))
    return F.when(bars >= cfg.min_hours_seen, F.greatest(coverage, consistency)).otherwise(F.lit(0.0))


def bucket_score(value: Column, t: Thresholds) -> Column:
    """Piecewise-linear score between four thresholds, flat above the last."""

    def between(lo: float, hi: float, s_lo: float, s_hi: float) -> Column:
        capped = F.least(value, F.lit(float(hi)))
        return F.lit(s_lo) + (capped - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(s_hi - s_lo)

    return (
        F.when(value < t.base, F.lit(0.0))
        .when(value < t.low, between(t.base, t.low, NONE_SCORE, LOW_SCORE))
        .when(value < t.medium, between(t.low, t.medium, LOW_SCORE, MEDIUM_SCORE))
        .otherwise(between(t.medium, t.high, MEDIUM_SCORE, HIGH_SCORE))
    )
