"""Flood detection on flow windows: rolling clean baseline, classification, alerts."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.config import FloodConfig
from wiretally.session import materialise

#: Windows of one destination that are walked in one piece, about.
CHUNK_ROWS = 4096

_METRICS = ("pkt_rate", "byte_rate", "src_ip_entropy")
_SCORES = "baseline_size int, pkt_z double, byte_z double, entropy_z double, flagged boolean"


def _moments(values: deque) -> tuple[float, float]:
    n = len(values)
    mean = sum(values) / n
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / n)


def judge(history: list[deque], metrics: tuple[float, ...], flows: int, cfg: FloodConfig) -> tuple:
    """Score one window against the clean history and learn it unless it is flagged.

    A window is learned or left out depending on its own verdict, so later baselines
    depend on earlier verdicts; no window frame can express that. Shared by the batch
    and the streaming operator.
    """
    size = len(history[0])
    scores: tuple = (None, None, None)
    flagged = False
    if flows >= cfg.min_flows and size >= 2:
        z = []
        for past, value in zip(history, metrics):
            mean, deviation = _moments(past)
            z.append((value - mean) / max(deviation, cfg.epsilon))
        scores = tuple(z)
        flagged = max(z[0], z[1]) >= cfg.z_threshold and abs(z[2]) >= cfg.entropy_z_threshold
    if not flagged:
        for past, value in zip(history, metrics):
            past.append(value)
    return (size, *scores, flagged)


def new_history(cfg: FloodConfig) -> list[deque]:
    return [deque(maxlen=cfg.baseline_windows) for _ in _METRICS]


def _chunked(windows: DataFrame, cfg: FloodConfig, rows: int) -> DataFrame:
    """Add ``chunk`` (0 first): stretches of time of one destination with at least ``rows`` windows each but for the last.

    Windows are counted per stretch of time first, so running sums pass over stretches, not over windows.
    """
    stretch = F.floor(F.unix_seconds("window_start") / max(rows * cfg.window_seconds // 4, 1))
    sizes = windows.groupBy("dst", stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("dst").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    chunks = sizes.select("dst", "_stretch", F.floor(F.coalesce(before, F.lit(0)) / rows).alias("chunk"))
    chunks = materialise(chunks, "flood-chunks")
    return windows.withColumn("_stretch", stretch).join(chunks, ["dst", "_stretch"]).drop("_stretch")


def _walk(pdf: pd.DataFrame, before: pd.DataFrame, cfg: FloodConfig) -> tuple[pd.DataFrame, list[tuple], list[deque]]:
    """Ordered windows of a chunk, their verdicts and the clean history after them."""
    pdf = pdf.sort_values("window_start", kind="stable")
    history = new_history(cfg)
    if len(before):
        for past, values in zip(history, before.before.iloc[0].reshape(len(_METRICS), -1)):
            past.extend(values.tolist())
    columns = zip(pdf.pkt_rate, pdf.byte_rate, pdf.src_ip_entropy, pdf.flow_count)
    return pdf, [judge(history, (p, b, e), f, cfg) for p, b, e, f in columns], history


def _histories(windows: DataFrame, cfg: FloodConfig) -> DataFrame:
    """(dst, chunk, before): the clean history before each chunk of the destinations with several chunks.

    Every chunk is walked as if nothing came before it, then again from what its predecessor
    left, until no chunk starts from another history than its predecessor ends with. The first
    chunk starts right, so by then all do. Chunks are long against a history, so the second walk
    is mostly the last; only chunks whose start has changed are walked again.
    """

    def after(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or before.empty:
            return pd.DataFrame(columns=["dst", "chunk", "before", "after"])
        _, _, history = _walk(pdf, before, cfg)
        out = before[["dst", "chunk", "before"]].copy()
        out["after"] = [[v for past in history for v in past]]
        return out

    key = ["dst", "chunk"]
    if not windows.where("chunk > 0").take(1):
        return windows.sparkSession.createDataFrame([], "dst string, chunk long, before array<double>")
    none = F.array().cast("array<double>")
    parts = windows.select(*key).distinct().withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("dst")))
    todo = known = materialise(parts.where("_all > 1").select(*key, none.alias("before")), "flood-parts")
    left = F.coalesce(F.lag("after").over(Window.partitionBy("dst").orderBy("chunk")), none)
    first = True
    while todo.take(1):
        own = windows.join(todo.select(*key), key, "left_semi").groupBy(*key)
        walked = own.cogroup(todo.groupBy(*key)).applyInPandas(after, "dst string, chunk long, before array<double>, after array<double>")
        walked = materialise(walked, "flood-histories")
        known = walked if first else materialise(known.join(walked, key, "left_anti").unionByName(walked), "flood-histories")
        todo = known.select(*key, "before", left.alias("_left")).where("before <> _left").select(*key, F.col("_left").alias("before"))
        first = False
    return known.select(*key, "before")


def score_windows(windows: DataFrame, cfg: FloodConfig = FloodConfig(), rows: int = CHUNK_ROWS) -> DataFrame:
    """Append z-scores and the verdict to every flow window.

    Works on aggregated windows, in chunks of about ``rows`` of one destination, which go to
    different tasks: a destination with a third of all windows is no group of its own. Each chunk
    starts from the clean history before it (:func:`_histories`), so the verdicts are those of
    one walk over the destination. Only the numbers needed travel to Python; the verdicts are
    joined back to the full rows.
    """
    windows = materialise(windows, "flood-windows")
    numbers = _chunked(windows.select("dst", "window_start", "flow_count", *_METRICS), cfg, rows)

    def scored(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf, verdicts, _ = _walk(pdf, before, cfg)
        out = pd.DataFrame(verdicts, columns=["baseline_size", "pkt_z", "byte_z", "entropy_z", "flagged"])
        out.insert(0, "window_start", pdf.window_start.to_numpy())
        out.insert(0, "dst", pdf.dst.to_numpy())
        return out

    histories = _histories(numbers, cfg).groupBy("dst", "chunk")
    scores = numbers.groupBy("dst", "chunk").cogroup(histories).applyInPandas(scored, f"dst string, window_start timestamp, {_SCORES}")
    return windows.join(scores, ["dst", "window_start"])


def flood_subtype(cfg: FloodConfig = FloodConfig()) -> Column:
    """Kind of flood, from the protocol mix and source diversity of a window."""
    syn_ratio = F.try_divide("tcp_syn_count", "tcp_flow_count")
    udp_ratio = F.try_divide("udp_flow_count", "flow_count")
    reply_ratio = F.try_divide("total_resp_ip_bytes", "total_orig_ip_bytes")
    sources = F.col("unique_source_count")
    return (
        F.when(syn_ratio >= cfg.syn_ratio, "syn_flood")
        .when(
            (udp_ratio >= cfg.udp_ratio)
            & (sources >= cfg.reflection_sources)
            & (reply_ratio >= cfg.reflection_ratio),
            "reflection_amplification_like",
        )
        .when(udp_ratio >= cfg.udp_ratio, "udp_flood")
        .when(sources >= cfg.spoofing_sources, "spoofing_like")
        .otherwise("volumetric_generic")
    )


def flood_confidence(cfg: FloodConfig = FloodConfig()) -> Column:
    raw = F.greatest("pkt_z", "byte_z") / (2 * cfg.z_threshold)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def flood_severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def detect_floods(windows: DataFrame, cfg: FloodConfig = FloodConfig()) -> DataFrame:
    """Flood findings: flagged windows with subtype, confidence and severity."""
    start = F.col("window_start").cast("bigint").cast("string")
    end = F.col("window_end").cast("bigint").cast("string")
    return (
        score_windows(windows, cfg)
        .filter("flagged")
        .withColumn("subtype", flood_subtype(cfg))
        .withColumn("confidence", flood_confidence(cfg))
        .withColumn("severity", flood_severity(F.col("confidence")))
        .withColumn(
            "source",
            F.when(F.col("unique_source_count") == 1, F.col("first_source")).otherwise("multiple"),
        )
        .withColumn("flow_id", F.concat_ws("_", F.lit("w"), "dst", start, end))
        .withColumn(
            "entropy_change", F.when(F.col("entropy_z") < 0, "drop").otherwise("spike")
        )
    )
